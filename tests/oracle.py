"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from urbanpulse import catalog


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark: SparkSession, name: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = catalog.queries()[name](spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.oracle_sql():
        return None if got else "no rows"
    con = tables(folder)
    result = con.execute(catalog.oracle_sql()[name])
    want_cols, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}"
    kinds = [(c, type(a), type(b)) for c, a, b in zip(got_cols, got[0] if got else (), want[0] if want else ())
             if a is not None and b is not None and type(a) is not type(b)]
    return f"types differ: {kinds}" if kinds else None
