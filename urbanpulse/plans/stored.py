"""Reports over what is stored: raw transit snapshots, the stop register and the normalized tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import CELL_KM, CITIES, CITY_BOX, KMEANS_ZONES, MIN_STOPS_PER_CELL, PERMUTATIONS, Period
from urbanpulse.operators.health import nominal_interval
from urbanpulse.operators.minute_fact import weather_minutes
from urbanpulse.operators.periods import with_periods
from urbanpulse.operators.zones import city_table
from urbanpulse.plans.normalization import FEEDS
from urbanpulse.plans.reports import health_report, spatial_report, zonal_correlations
from urbanpulse.session import materialise, path_exists
from urbanpulse.sources.feeds import read_stops
from urbanpulse.sources.snapshots import RAW_LAYOUT, file_table, read_normalized_table, scan_feed, stop_rows


def span(periods: Sequence[Period]) -> tuple[str, str]:
    """First and last date of all periods."""
    return min(p.start for p in periods).strftime("%Y-%m-%d"), max(p.end for p in periods).strftime("%Y-%m-%d")


def stored_updates(spark: SparkSession, raw: str, periods: Sequence[Period]) -> DataFrame:
    """Stop updates of the periods' date folders, written once: the reports read them several times."""
    return materialise(stop_rows(scan_feed(spark, raw, "trips", dates=span(periods))))


def city_report(spark: SparkSession, raw: str, stops: str, periods: Sequence[Period], permutations: int = PERMUTATIONS,
                cities: Sequence[tuple] = CITIES, cell_km: float = CELL_KM, min_stops: int = MIN_STOPS_PER_CELL) -> dict[str, DataFrame]:
    """Zones, their metrics and Moran's I for all cities and windows; a city counts its own operator's updates."""
    return spatial_report(stored_updates(spark, raw, periods), read_stops(spark, stops), city_table(spark, cities), periods,
                          permutations, cell_km, min_stops)


def zone_report(spark: SparkSession, raw: str, tables: str, stops: str, periods: Sequence[Period], k: int = KMEANS_ZONES,
                box: dict[str, float] | None = CITY_BOX) -> dict[str, DataFrame]:
    """k-means zones of the stops in use inside the box, against road temperature, per period."""
    updates = with_periods(stored_updates(spark, raw, periods), F.col("minute"), periods)
    weather = with_periods(read_normalized_table(spark, tables, "road_weather", span(periods)), F.col("timestamp"), periods)
    correlations, centroids = zonal_correlations(
        updates, read_stops(spark, stops), weather_minutes(weather, ("period",)), ("period",), k, box)
    return {"correlations": correlations, "centroids": centroids}


def feed_health(spark: SparkSession, raw: str, periods: Sequence[Period]) -> dict[str, DataFrame]:
    """Gaps and throughput of every feed's snapshot files, and the latency of transit rows, per period."""
    landed = [f for f in FEEDS if path_exists(spark, f"{raw.rstrip('/')}/{RAW_LAYOUT[f][0]}")]
    if not landed:
        raise ValueError(f"{raw}: no feed has landed there")
    files = None
    for feed in landed:
        own = file_table(scan_feed(spark, raw, feed, dates=span(periods)), feed)
        files = own if files is None else files.unionByName(own)
    events = None
    if "trips" in landed:
        rows = scan_feed(spark, raw, "trips", dates=span(periods))
        events = rows.select(F.lit("trips").alias("source"), F.col("timestamp").alias("event_epoch"), F.col("_file_time").alias("arrival"))
    return health_report(spark, materialise(files), periods, nominal_interval(F.col("source")), events)
