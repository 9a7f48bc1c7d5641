"""Weather impact on mobility: one fact table, all statistics, any number of periods."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import Period
from urbanpulse.operators import correlate, peak
from urbanpulse.operators.minute_fact import (
    minute_fact,
    temperature_summary,
    weather_minutes,
    with_index,
    with_zone,
)
from urbanpulse.operators.periods import effective_time, part_of_day, with_periods
from urbanpulse.sources.snapshots import read_normalized_table

KEY = ("period",)


def feeds_in_periods(feeds: dict[str, DataFrame], periods: Sequence[Period]) -> dict[str, DataFrame]:
    """Every feed restricted and copied to the periods its rows fall in.

    A row counts only if the folder it was collected in lies in the period as well.
    """
    return {
        name: with_periods(df, effective_time(name), periods, F.col("date") if "date" in df.columns else None)
        for name, df in feeds.items()
    }


def period_fact(feeds: dict[str, DataFrame], periods: Sequence[Period], unit: str = "minute",
                hours: tuple[int, int] | None = None, strict: bool = True) -> DataFrame:
    """Fact table with the index, keyed by period. The part of day is cut after the index is scaled."""
    fact = with_index(minute_fact(feeds_in_periods(feeds, periods), KEY, unit, strict), KEY)
    return fact.where(part_of_day(F.col("minute"), *hours)) if hours else fact


@dataclass
class Impact:
    """Result tables of an analysis; each is a DataFrame with a `period` column."""

    fact: DataFrame
    correlations: DataFrame
    interpretation: DataFrame
    regression: DataFrame
    temperature: DataFrame
    robustness: DataFrame
    interactions: DataFrame
    peak_offpeak: DataFrame
    variants: DataFrame
    pooled: DataFrame
    status: DataFrame
    weather_by_zone: DataFrame | None = None
    zone_correlations: DataFrame | None = None


def analyse(spark: SparkSession, feeds: dict[str, DataFrame], periods: Sequence[Period], unit: str = "minute",
            hours: tuple[int, int] | None = None, location_zone: DataFrame | None = None) -> Impact:
    """All period statistics over one fact table, which is written once (see `with_index`)."""
    fact = period_fact(feeds, periods, unit, hours)
    correlations = correlate.weather_correlations(fact, KEY)
    by_zone = zone_corr = None
    if location_zone is not None:
        zoned = feeds_in_periods({"road_weather": with_zone(feeds["road_weather"], location_zone)}, periods)
        by_zone = weather_minutes(zoned["road_weather"].where(F.col("zone").isNotNull()), ("period", "zone"), unit)
        zone_corr = correlate.zone_correlations(by_zone, fact, KEY)
    return Impact(
        fact=fact,
        correlations=correlations,
        interpretation=correlate.interpretations(correlations, KEY),
        regression=correlate.regression(fact, keys=KEY),
        temperature=temperature_summary(fact, KEY),
        robustness=correlate.delay_robustness(fact, KEY),
        interactions=correlate.mode_interactions(fact, KEY),
        peak_offpeak=peak.peak_offpeak(fact, keys=KEY),
        variants=peak.variant_peaks(fact, KEY),
        pooled=peak.pooled_ratio(peak.window_ratios(fact, keys=KEY)),
        status=period_status(spark, fact, periods),
        weather_by_zone=by_zone,
        zone_correlations=zone_corr,
    )


def period_status(spark: SparkSession, fact: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Every asked period with its minutes; one without weather is reported, not dropped."""
    asked = spark.createDataFrame([(p.name,) for p in periods], "period string")
    minutes = fact.groupBy("period").agg(F.count(F.lit(1)).alias("sample_size_minutes"))
    n = F.coalesce(F.col("sample_size_minutes"), F.lit(0).cast("bigint"))
    return asked.join(minutes, "period", "left").select(
        "period", n.alias("sample_size_minutes"),
        F.when(n > 0, "ok").otherwise("No weather data available for analysis").alias("status"))


def analyse_table(spark: SparkSession, base: str, periods: Sequence[Period], **options) -> Impact:
    """Analyse the normalized table; only the date partitions of the periods are read.

    If no feed has a partition in the periods, all of them are read and placed by the rows' own time.
    """
    span = (min(p.start for p in periods).strftime("%Y-%m-%d"), max(p.end for p in periods).strftime("%Y-%m-%d"))
    names = ("road_weather", "bikes", "flights", "trips", "travel_times", "situations")
    inside = F.col("date").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
    stored = {n: read_normalized_table(spark, base, n) for n in names}
    feeds = {n: df for n, d in stored.items() if not (df := d.where(inside)).isEmpty()}
    if not feeds:
        feeds = {n: df.drop("date") for n, df in stored.items() if not df.isEmpty()}
    return analyse(spark, feeds, periods, **options)


def summary_row(correlations: DataFrame, hours: str = "") -> DataFrame:
    """The line kept per analysis: part of day, seven temperature correlations and the sample size."""
    names = ("bikes", "public_transport", "flight_activity", "multimodal", "delay", "travel_time", "traffic_incidents")
    return correlations.select(
        "period", F.lit(hours).alias("part_of_day"), *[f"temperature_vs_{n}" for n in names], "sample_size_minutes")


