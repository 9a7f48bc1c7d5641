"""Rush hour against the rest: Welch tests and pooled ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.fixed import INDEX_VARIANTS
from urbanpulse.functions.stats import split_moments, welch_columns
from urbanpulse.functions.times import is_peak
from urbanpulse.operators.correlate import pair_correlations
from urbanpulse.operators.minute_fact import with_variants

METRICS = {
    "bikes": "bikes_in_use",
    "public_transport": "public_transport_activity",
    "flight": "flight_activity",
    "multimodal": "multimodal_activity",
    "delay": "mean_delay_sec",
}


def long_metrics(fact: DataFrame, metrics: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, minute, metric, value), without rows that have no value."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value"))
        for k, c in metrics.items() if c in fact.columns
    ])).alias("m")
    return fact.select(*keys, "minute", cells).select(*keys, "minute", "m.metric", "m.value").where(
        F.col("value").isNotNull())


def split_stats(fact: DataFrame, metrics: dict[str, str] = METRICS, keys: Sequence[str] = (),
                flag: Column | None = None) -> DataFrame:
    """Count, mean and variance in and out of the rush hour, per key and metric."""
    flag = is_peak(F.col("minute")) if flag is None else flag
    return long_metrics(fact, metrics, keys).groupBy(*keys, "metric").agg(*split_moments(F.col("value"), flag))


def peak_offpeak(fact: DataFrame, metrics: dict[str, str] = METRICS, keys: Sequence[str] = ()) -> DataFrame:
    """Welch test of rush hour against the rest, per key and metric."""
    stats = split_stats(fact, metrics, keys)
    return stats.select(*keys, "metric", "n_peak", "n_offpeak", *welch_columns())


def window_ratios(fact: DataFrame, metrics: dict[str, str] = METRICS, keys: Sequence[str] = ("period",)) -> DataFrame:
    """Plain means and their ratio; needs two minutes on each side."""
    stats = split_stats(fact, metrics, keys).where((F.col("n_peak") >= 2) & (F.col("n_offpeak") >= 2))
    return stats.select(*keys, "metric", "n_peak", "n_offpeak", "mean_peak", "mean_offpeak",
                        F.try_divide("mean_peak", "mean_offpeak").alias("ratio"))


def pooled_ratio(ratios: DataFrame) -> DataFrame:
    """Minutes of all windows pooled before the ratio, with the range over the windows."""
    def pooled(side: str) -> Column:
        return F.try_divide(F.sum(F.col(f"n_{side}") * F.col(f"mean_{side}")), F.sum(f"n_{side}"))

    return ratios.groupBy("metric").agg(
        F.try_divide(pooled("peak"), pooled("offpeak")).alias("weighted_ratio"),
        F.min("ratio").alias("range_min"), F.max("ratio").alias("range_max"), F.count(F.lit(1)).alias("n_windows"))


def variant_peaks(fact: DataFrame, keys: Sequence[str] = (), variants: dict[str, Sequence[str]] = INDEX_VARIANTS) -> DataFrame:
    """Welch test of each index definition."""
    ready = with_variants(fact, variants, keys)
    return peak_offpeak(ready, {v: v for v in variants}, keys).withColumnRenamed("metric", "variant")


def variant_correlations(fact: DataFrame, keys: Sequence[str] = (),
                         variants: dict[str, Sequence[str]] = INDEX_VARIANTS) -> DataFrame:
    """Temperature against each index definition."""
    ready = with_variants(fact, variants, keys)
    return pair_correlations(ready, {v: ("road_temperature", v) for v in variants}, keys, "variant")
