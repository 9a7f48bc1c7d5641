"""Rounding that does not depend on the order of a distributed sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """Half-up rounding after dropping what lies beyond twelve decimals.

    Partial sums arrive in any order, so a double may differ in its last bits from run to
    run; without this a value on a rounding tie would flip between two results. Values too
    large for that are rounded as they are; NaN is null.
    """
    value = F.col(value) if isinstance(value, str) else value
    exact = F.round(value.try_cast("decimal(38,12)"), digits).cast("double")
    double = value.cast("double")
    return F.coalesce(exact, F.when(~F.isnan(double), F.round(double, digits)))
