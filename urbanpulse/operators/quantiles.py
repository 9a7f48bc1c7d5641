"""Exact order statistics of groups of any size and distribution, in two passes.

The first pass builds a rank sketch of each group on the map side (Greenwald-Khanna summaries merge, and hold a fixed share of
ranks), which brackets each wanted rank by two values. The second one counts: rows outside the brackets fall into one
count for each gap between brackets, rows inside are counted by value. So a running sum over what is left, at most
a few ten-thousandths of a group, gives the exact value. Brackets come from ranks, not from distances, so
outliers, ties and infinities cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.session import beside

ACCURACY = 10_000  # a sketch's ranks are off by one part in this many at most
MARGIN = 4 / ACCURACY
MARKS = 1_000  # marks of a weighted group
FEW = 50_000  # rows of a group that one task may rank without a bracket

Pick = tuple[float, Callable[[Column], Column]]


def order_statistics(df: DataFrame, by: Sequence[str], value: str, picks: dict[str, Pick], weight: str | None = None) -> DataFrame:
    """Per group: `n` and, for each pick, the value at its 0-based rank.

    A pick is a share of the group and the rank as a function of n, which lies within two ranks of it. `weight` says how many
    times a row counts. Null and NaN values are left out; infinities are the least and the greatest values.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(
        *by, v.alias("_v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("_w"))
    shares = list(dict.fromkeys(p for p, _ in picks.values()))
    state = weighted_brackets(rows, by, picks) if weight else brackets(rows, by, shares)
    placed = beside(rows, state, by)
    inside = F.exists("_b", lambda b: F.col("_v").between(b["lo"], b["hi"]))
    below = F.array_max(F.filter(F.transform("_b", lambda b: b["hi"]), lambda hi: hi < F.col("_v")))
    counted = placed.groupBy(*by, F.when(inside, F.col("_v")).otherwise(below).alias("_at"), (~inside).alias("_gap")).agg(
        F.sum("_w").alias("_w"), F.first("_n").alias("n"))
    running = W.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first(), "_gap").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("_through", F.sum("_w").over(running)).where(~F.col("_gap"))

    def here(rank: Callable[[Column], Column]) -> Column:
        at = rank(F.col("n")).cast("bigint")
        return (F.col("_through") - F.col("_w") <= at) & (at < F.col("_through"))

    return ranked.groupBy(*by).agg(
        F.first("n").alias("n"), *[F.max(F.when(here(rank), F.col("_at"))).alias(name) for name, (_, rank) in picks.items()])


def brackets(rows: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """by, _n and _b: for each share two values that its rank lies between."""
    ends = [F.lit(min(1.0, max(0.0, p + d))) for p in shares for d in (-MARGIN, MARGIN)]
    told = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*ends), F.lit(ACCURACY)).alias("_q"))
    near = F.array(*[F.struct(F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi")) for i in range(len(shares))])
    return told.select(*by, "_n", F.when(F.col("_n") > FEW, near).otherwise(whole()).alias("_b"))


def whole() -> Column:
    return F.array(F.struct(F.col("_min").alias("lo"), F.col("_max").alias("hi")))


def weighted_brackets(rows: DataFrame, by: Sequence[str], picks: dict[str, Pick]) -> DataFrame:
    """The same where rows count several times: marks cut the rows of a large group evenly, and weights between them are added up."""
    marks = [F.lit(k / MARKS) for k in range(1, MARKS)]
    big = F.count(F.lit(1)) > FEW
    told = rows.groupBy(*by).agg(
        F.sum("_w").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.when(big, F.percentile_approx("_v", F.array(*marks), F.lit(10 * MARKS))).alias("_marks"))
    steps = F.array(*[F.lit(1 << k) for k in range(MARKS.bit_length() - 1, -1, -1)])
    # how many marks lie below the value, by halving
    slot = F.aggregate(steps, F.lit(0), lambda got, step: F.when(
        (got + step < MARKS) & (F.get("_marks", got + step - 1) < F.col("_v")), got + step).otherwise(got))
    large = told.where(F.col("_marks").isNotNull())
    weights = beside(rows, large, by).groupBy(*by, slot.alias("_slot")).agg(
        F.sum("_w").alias("_w"), F.first("_n").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    through = F.sum("_w").over(W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = F.array(*[rank(F.col("_n")).cast("bigint") for _, rank in picks.values()])
    holds = F.exists(ranks, lambda r: (F.col("_through") - F.col("_w") <= r) & (r < F.col("_through")))
    found = weights.withColumn("_through", through).where(holds).groupBy(*by).agg(
        F.first("_n").alias("_n"), F.collect_list(F.struct("lo", "hi")).alias("_b"))
    few = told.where(F.col("_marks").isNull()).select(*by, "_n", whole().alias("_b"))
    return few.unionByName(found)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float],
                    weight: str | None = None) -> DataFrame:
    """Quantiles with linear interpolation between neighbouring ranks, one column per named probability.

    Between a finite value and an infinity the quantile is that infinity, between both infinities NaN.
    """
    picks: dict[str, Pick] = {}
    for name, p in probabilities.items():
        picks[f"_{name}_low"] = (p, lambda n, p=p: F.floor((n - 1) * F.lit(float(p))))
        picks[f"_{name}_high"] = (p, lambda n, p=p: F.ceil((n - 1) * F.lit(float(p))))
    stats = order_statistics(df, by, value, picks, weight)

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        position = (F.col("n") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        infinite = F.greatest(F.abs(low), F.abs(high)) == F.lit(float("inf"))
        return F.when(low == high, low).when(infinite, low * (1 - share) + high * share).otherwise(low + (high - low) * share).alias(name)

    return stats.select(*by, "n", *[between(n, p) for n, p in probabilities.items()])
