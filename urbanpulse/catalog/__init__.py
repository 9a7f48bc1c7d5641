"""Registered queries over the driver tables and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("facts", "statistics", "normalizing", "spatial", "anomalies", "feedhealth", "streams", "landing", "runs")


def queries() -> dict[str, Query]:
    return {n: q for m in MODULES for n, q in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in import_module(f"{__name__}.{m}").ORACLES.items()}


def exact_rounding(sql: str) -> str:
    """`round(x, n)` through a decimal, as the library rounds: ties do not depend on the last bits."""
    out, i = [], 0
    while (start := sql.find("round(", i)) >= 0:
        depth, comma, end = 0, None, start + 5
        while True:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        value, digits = exact_rounding(sql[start + 6:comma]), sql[comma + 1:end].strip()
        out += [sql[i:start], f"CAST(round(CAST({value} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"]
        i = end + 1
    return "".join([*out, sql[i:]])


class Register:
    """Collects a module's queries and SQL under the same name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = exact_rounding(sql)
            return fn

        return add
