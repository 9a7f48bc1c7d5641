"""Union of tables with different schemas, by rule, decided on schemas alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.functions.nested import top

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


def _rank_first(types: list[T.DataType]) -> T.DataType:
    """Text over time over date over float over integer over boolean; nothing but nulls is text."""
    order = (
        ((T.StringType,), T.StringType()),
        ((T.TimestampType, T.TimestampNTZType), T.TimestampType()),
        ((T.DateType,), T.DateType()),
        (_FLOATS, T.DoubleType()),
        (_INTEGERS, T.LongType()),
        ((T.BooleanType,), T.BooleanType()),
    )
    for members, result in order:
        if any(isinstance(t, members) for t in types):
            return result
    known = [t for t in types if not isinstance(t, T.NullType)]
    return known[0] if known else T.StringType()


def _widen(types: list[T.DataType]) -> T.DataType:
    """Numbers that differ become double, any text makes text, otherwise the first known type."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return T.StringType()
    if all(t == known[0] for t in known):
        return known[0]
    if any(isinstance(t, T.StringType) for t in known):
        return T.StringType()
    if all(isinstance(t, _INTEGERS + _FLOATS) for t in known):
        return T.DoubleType()
    return known[0]


RULES = {"rank": _rank_first, "widen": _widen}


def unified_schema(frames: list[DataFrame], rule: str = "rank") -> T.StructType:
    names: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema.fields:
            names.setdefault(field.name, []).append(field.dataType)
    return T.StructType([T.StructField(n, RULES[rule](types)) for n, types in names.items()])


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema: bad values and missing columns are null, extra columns are dropped."""
    def column(field: T.StructField):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if df.schema[field.name].dataType == field.dataType:
            return top(field.name)
        return top(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def unify(frames: list[DataFrame], rule: str = "rank") -> DataFrame:
    """Union by name under one schema; columns a table lacks are null."""
    schema = unified_schema(frames, rule)
    return reduce(lambda a, b: a.unionByName(b), [project(df, schema) for df in frames])


def align(frames: list[DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """Union under a declared schema, by default that of the first table."""
    schema = schema or frames[0].schema
    return reduce(lambda a, b: a.unionByName(b), [project(df, schema) for df in frames])

