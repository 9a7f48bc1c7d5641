"""Helpers driven by the schema alone: no data is looked at."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def top(name: str) -> Column:
    """Column by its whole name, dots included."""
    return F.col(quoted(name))


def field_path(column: Column, dtype: T.DataType, path: Iterable[str]) -> Column:
    """Nested field, null when any step is null or absent from the schema."""
    for step in path:
        if not (isinstance(dtype, T.StructType) and step in dtype.fieldNames()):
            return F.lit(None).cast("string")
        column, dtype = column.getField(quoted(step) if "." in step else step), dtype[step].dataType
    return column


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs to top-level columns with joined names; arrays stay as they are."""
    out: list[Column] = []

    def walk(column: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                walk(column.getField(field.name), field.dataType, f"{name}{separator}{field.name}")
        else:
            out.append(column.alias(name))

    for field in df.schema.fields:
        walk(top(field.name), field.dataType, field.name)
    return df.select(*out)


def join_scalar_lists(column: Column, dtype: T.DataType) -> Column:
    """Lists of scalars to comma-joined text, at every depth."""
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, (T.StructType, T.ArrayType)):
            return F.transform(column, lambda item: join_scalar_lists(item, inner))
        return F.array_join(F.transform(column, lambda item: item.cast("string")), ",", "None")
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[
            join_scalar_lists(column.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields
        ])
        return F.when(column.isNotNull(), rebuilt)
    return column


def clean_lists(df: DataFrame) -> DataFrame:
    return df.select(*[join_scalar_lists(top(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def as_list(column: Column, dtype: T.DataType) -> Column:
    """A scalar becomes a one-item list, null an empty one, a list stays."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(column, F.array().cast(dtype))
    return F.when(column.isNull(), F.array().cast(T.ArrayType(dtype))).otherwise(F.array(column))


def first_match(names: list[str], needles: Iterable[str]) -> str | None:
    """First name that contains the earliest needle, ignoring case."""
    for needle in needles:
        for name in names:
            if needle in name.lower():
                return name
    return None


def last_match(names: list[str], needles: Iterable[str], stops: Iterable[str]) -> str | None:
    """Like `first_match`, but a name ends the search only if it also contains a stop word."""
    for needle in needles:
        found = None
        for name in names:
            if needle in name.lower():
                found = name
                if any(stop in name.lower() for stop in stops):
                    break
        if found is not None:
            return found
    return None


def optional(df: DataFrame, name: str, dtype: str) -> Column:
    """The column cast to its declared type, or a typed null when the table lacks it."""
    present = top(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)
    return present.alias(name)
