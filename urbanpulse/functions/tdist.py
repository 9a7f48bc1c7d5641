"""Student t distribution for rows that are already aggregated.

Spark has no t distribution, so two Arrow-batched functions evaluate the regularised
incomplete beta function (continued fraction) on the few result rows of a test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return math.nan
    return beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def quantile(q: float, df: float) -> float:
    """t value with lower-tail probability q, by bisection on the two-sided tail."""
    if not (0.0 < q < 1.0 and df > 0):
        return math.nan
    tail = 2.0 * min(q, 1.0 - q)
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > tail and high < 1e12:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if two_sided_p(mid, df) > tail:
            low = mid
        else:
            high = mid
    return math.copysign((low + high) / 2.0, q - 0.5)


def _rowwise(fn, first: pd.Series, second: pd.Series) -> pd.Series:
    """NaN marks a missing result; Spark turns it into null."""
    known = first.notna() & second.notna()
    out = pd.Series(np.nan, index=first.index, dtype="float64")
    out[known] = [fn(float(a), float(b)) for a, b in zip(first[known], second[known])]
    return out


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(two_sided_p, t, df)


@F.pandas_udf(T.DoubleType())
def t_quantile(q: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(quantile, q, df)
