"""Spatial, anomaly and feed-health reports over all cities, modes and sources at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import CELL_KM, KMEANS_ZONES, MIN_STOPS_PER_CELL, PERMUTATIONS, Period
from urbanpulse.functions.geo import in_box
from urbanpulse.functions.rounding import rounded
from urbanpulse.functions.stats import pair_count, safe_corr
from urbanpulse.operators import anomaly, health, zones
from urbanpulse.operators.kmeans import kmeans_zones
from urbanpulse.operators.moran import cluster_counts, moran
from urbanpulse.operators.periods import with_periods
from urbanpulse.session import materialise, small_side

WINDOW_CITY = ("period", "city")


def spatial_report(updates: DataFrame, stops: DataFrame, cities: DataFrame, periods: Sequence[Period],
                   permutations: int = PERMUTATIONS, cell_km: float = CELL_KM,
                   min_stops: int = MIN_STOPS_PER_CELL) -> dict[str, DataFrame]:
    """Zone activity, delay and peak ratio per window and city, each with global and local Moran's I."""
    zoned = materialise(zones.grid_zones(stops, cities, cell_km, min_stops))
    placed = with_periods(updates, F.col("minute"), periods)
    summary = zones.zone_summary(zoned)
    activity = materialise(zones.zones_with_metrics(summary, zones.zone_activity(placed, zoned, ("period",)), ("period",)))
    ratio = materialise(zones.zones_with_metrics(
        summary, zones.zone_peak_ratio(zones.zone_minutes(placed, zoned, ("period",)), ("period",)), ("period",)))
    glob, loc = [], []
    for table, metric in ((activity, "activity"), (activity, "delay"), (ratio, "ratio")):
        g, one = moran(table, metric, WINDOW_CITY, permutations)
        glob.append(g)
        loc.append(one)
    overall, local = glob[0].unionByName(glob[1]).unionByName(glob[2]), loc[0].unionByName(loc[1]).unionByName(loc[2])
    return {"zones": activity, "peak_ratio": ratio, "global": overall, "local": local,
            "clusters": cluster_counts(local, WINDOW_CITY)}


def zonal_correlations(updates: DataFrame, stops: DataFrame, temperature: DataFrame, keys: Sequence[str] = (),
                       k: int = KMEANS_ZONES, box: dict[str, float] | None = None, starts: int = 10,
                       min_rows: int = 4, digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """k-means zones of the stops in use, and each zone's activity and delay against temperature.

    Returns (correlations, zone centroids).
    """
    keys = list(keys)
    per_stop = updates.groupBy(*keys, "stop_id", "minute").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("arrival_delay").alias("_sum"), F.count("arrival_delay").alias("_obs"))
    inside = stops.where(in_box(F.col("stop_lat"), F.col("stop_lon"), box)) if box else stops
    used = inside.join(per_stop.select("stop_id").distinct(), "stop_id", "left_semi").distinct()
    zoned = materialise(kmeans_zones(used, k, starts))
    minutes = per_stop.join(small_side(zoned.select("stop_id", "zone")), "stop_id").groupBy(*keys, "zone", "minute").agg(
        F.sum("_n").alias("pt_activity"), F.try_divide(F.sum("_sum").cast("double"), F.sum("_obs")).alias("pt_delay_mean"))
    joined = minutes.join(temperature.select(*keys, "minute", "road_temperature"), [*keys, "minute"])

    def pair(metric: str) -> list[Column]:
        n, t = pair_count(F.col("road_temperature"), F.col(metric)), F.col("road_temperature")
        return [n.alias(f"n_{metric}"),
                F.when(n >= min_rows, rounded(safe_corr(t, F.col(metric)), digits)).alias(f"r_{metric}")]

    correlations = joined.groupBy(*keys, "zone").agg(*pair("pt_activity"), *pair("pt_delay_mean"))
    centroids = zoned.groupBy("zone").agg(
        F.avg("stop_lat").alias("centroid_lat"), F.avg("stop_lon").alias("centroid_lon"),
        F.count(F.lit(1)).alias("n_stops"))
    return correlations, centroids


def anomaly_report(features: DataFrame, names: Sequence[str], row_id: str = "hour", **forest) -> dict[str, DataFrame]:
    """Detection over (period, mode) groups of hourly features and the tables made from it."""
    group = ("period", "mode")
    scored = materialise(anomaly.detect_anomalies(features, group, names, row_id, **forest))
    return {
        "scored": scored,
        "summary": anomaly.anomaly_summary(scored, group),
        "heatmap": anomaly.anomaly_heatmap(scored),
        "boundary": anomaly.score_boundary(scored),
        "histogram": anomaly.score_histogram(scored, group),
        "boxes": anomaly.box_stats(scored, names),
        "density": anomaly.rolling_density(scored, group),
    }


def health_report(spark: SparkSession, files: DataFrame, periods: Sequence[Period], nominal: Column,
                  events: DataFrame | None = None, throughput_files: int | None = None,
                  latency_days: int | None = None) -> dict[str, DataFrame]:
    """Robustness, throughput and (given event times) latency per window and source.

    `files` has source, key, last_modified and n_rows; `events` has source, event_epoch and
    arrival. All files and days count, unless the caller asks for the first files of a source
    or the first days of a window.
    """
    key = ("period", "source")
    placed = materialise(with_periods(files, F.col("last_modified"), periods))
    first_day = placed.groupBy("period").agg(F.min(F.col("last_modified").cast("date")).alias("_first"))
    sample_day = placed.join(first_day, "period").where(F.col("last_modified").cast("date") == F.col("_first"))
    out = {
        "robustness": health.gap_stats(placed, nominal, key),
        "throughput": health.throughput_stats(placed, nominal, key, sample_day, throughput_files),
    }
    if events is not None:
        early = with_periods(events, F.col("arrival"), periods)
        if latency_days is not None:
            begin = spark.createDataFrame([(p.name, p.start.date()) for p in periods], "period string, _begin date")
            early = early.join(begin, "period").where(F.date_diff(F.col("arrival").cast("date"), F.col("_begin")) < latency_days)
        samples = health.latencies(early, F.col("event_epoch"), F.col("arrival"), key)
        out["latency"] = health.latency_stats(samples, key)
    return out
