"""Aggregate and post-aggregate column builders that never raise on degenerate data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanpulse.fixed import NORMAL_95, TRIVIAL_P, TRIVIAL_RATIO_BAND
from urbanpulse.functions.rounding import rounded
from urbanpulse.functions.tdist import t_quantile, t_two_sided_p


def paired(x: Column, y: Column) -> tuple[Column, Column]:
    """Both columns as doubles, kept only where both are present."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of complete pairs; null for a constant column or fewer than two pairs."""
    px, py = paired(x, y)
    varies = (F.max(px) > F.min(px)) & (F.max(py) > F.min(py))
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_t(r: Column, n: Column) -> Column:
    return F.when(n > 2, F.try_divide(r * F.sqrt((n - 2).cast("double")), F.sqrt(1 - r * r)))


def pearson_columns(r: Column, n: Column, digits: int = 3) -> list[Column]:
    """r, p, ci_low and ci_high of a correlation already aggregated over n pairs."""
    # F.greatest keeps both square roots real when the row is degenerate
    df = F.greatest((n - 2).cast("double"), F.lit(1.0))
    p = F.when(n > 2, t_two_sided_p(correlation_t(r, n), df))
    inside = (F.abs(r) < 1) & (n > 3)
    z = F.atanh(F.when(inside, r))
    half = F.lit(NORMAL_95) / F.sqrt(F.greatest((n - 3).cast("double"), F.lit(1.0)))
    return [
        rounded(r, digits).alias("r"),
        p.alias("p"),
        rounded(F.tanh(z - half), digits).alias("ci_low"),
        rounded(F.tanh(z + half), digits).alias("ci_high"),
    ]


def split_moments(value: Column, flag: Column) -> list[Column]:
    """Count, mean and sample variance on both sides of a flag, in one pass."""
    value = value.cast("double")
    out = []
    for side, keep in (("peak", flag), ("offpeak", ~flag)):
        v = F.when(keep, value)
        out += [
            F.count(v).alias(f"n_{side}"),
            F.avg(v).alias(f"mean_{side}"),
            F.try_divide(F.var_pop(v) * F.count(v), F.count(v) - 1).alias(f"var_{side}"),
        ]
    return out


def welch_columns(digits: int = 3) -> list[Column]:
    """Welch test on the columns made by `split_moments`; null where a side has fewer than two rows."""
    n1, n2 = F.col("n_peak").cast("double"), F.col("n_offpeak").cast("double")
    m1, m2 = F.col("mean_peak"), F.col("mean_offpeak")
    enough = (n1 >= 2) & (n2 >= 2)
    a, b = F.try_divide(F.col("var_peak"), n1), F.try_divide(F.col("var_offpeak"), n2)
    se = F.sqrt(a + b)
    t = F.when(enough, F.try_divide(m1 - m2, se))
    df = F.when(enough, F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1)))
    ratio = F.when(enough, F.try_divide(m1, m2))
    p = t_two_sided_p(t, df)
    reach = t_quantile(F.lit(0.975), df) * se
    return [
        rounded(m1, digits).alias("mean_peak"),
        rounded(m2, digits).alias("mean_offpeak"),
        rounded(ratio, digits).alias("ratio"),
        rounded(t, digits).alias("welch_t"),
        df.alias("df"),
        p.alias("p"),
        rounded(m1 - m2 - reach, digits).alias("ci_low"),
        rounded(m1 - m2 + reach, digits).alias("ci_high"),
        ((F.abs(ratio - 1) < TRIVIAL_RATIO_BAND) & (p < TRIVIAL_P)).alias("trivial_effect"),
        F.when(enough, "ok").otherwise("insufficient data").alias("status"),
    ]


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low); a constant column scales to 0."""
    return F.when(high > low, F.try_divide(value - low, high - low)).otherwise(F.lit(0.0))
