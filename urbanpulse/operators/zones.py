"""Grid zones over stops and their activity, for all cities and windows in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import CELL_KM, CITIES, MIN_STOPS_PER_CELL
from urbanpulse.functions.geo import cell_box, cell_index, lat_step, lon_step, near_centre, zone_name
from urbanpulse.functions.times import is_peak
from urbanpulse.session import small_side
from urbanpulse.sources.schemas import REAL, each, struct

CITY_SCHEMA = struct({**each("city operator"), **each("lat_c lon_c dlat dlon", REAL)})


def city_table(spark: SparkSession, cities: Sequence[tuple] = CITIES) -> DataFrame:
    """City boxes."""
    return spark.createDataFrame([tuple(c) for c in cities], CITY_SCHEMA)


def with_cells(stops: DataFrame, cities: DataFrame, cell_km: float = CELL_KM) -> DataFrame:
    """Stops inside each city's open box with their grid cell and zone id.

    Stops that already name their city join on it. Otherwise candidate cities are found by
    whole degrees of latitude (an equi join), then tested exactly.
    """
    if "city" in stops.columns:
        joined = stops.join(small_side(cities), "city")
    else:
        degrees = F.sequence(F.floor(F.col("lat_c") - F.col("dlat")), F.floor(F.col("lat_c") + F.col("dlat")))
        near = small_side(cities.withColumn("_degree", F.explode(degrees)))
        joined = stops.withColumn("_degree", F.floor("stop_lat")).join(near, "_degree").drop("_degree")
    c = F.col
    inside = joined.where(
        near_centre(c("stop_lat"), c("stop_lon"), c("lat_c"), c("lon_c"), c("dlat"), c("dlon")))
    return inside.withColumns({
        "cx": cell_index(c("stop_lat"), c("lat_c"), c("dlat"), F.lit(lat_step(cell_km))),
        "cy": cell_index(c("stop_lon"), c("lon_c"), c("dlon"), lon_step(c("lat_c"), cell_km)),
    }).withColumn("zone_id", zone_name(c("city"), c("cx"), c("cy")))


def retained_cells(cells: DataFrame, min_stops: int = MIN_STOPS_PER_CELL) -> DataFrame:
    """Stops in cells that have enough of them."""
    kept = cells.groupBy("zone_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_stops)
    return cells.join(kept.select("zone_id"), "zone_id", "left_semi")


def grid_zones(stops: DataFrame, cities: DataFrame, cell_km: float = CELL_KM,
               min_stops: int = MIN_STOPS_PER_CELL) -> DataFrame:
    cells = retained_cells(with_cells(stops, cities, cell_km), min_stops)
    return cells.select("city", "operator", "stop_id", "stop_lat", "stop_lon", "cx", "cy", "zone_id")


def zone_summary(zoned: DataFrame, min_stops: int = 0) -> DataFrame:
    """Centroid and stop count per zone; `min_stops` drops thin zones without a second pass."""
    out = zoned.groupBy("city", "zone_id", "cx", "cy").agg(
        F.avg("stop_lat").alias("centroid_lat"), F.avg("stop_lon").alias("centroid_lon"),
        F.count(F.lit(1)).alias("n_stops"))
    return out.where(F.col("n_stops") >= min_stops) if min_stops else out


def zone_boxes(zones: DataFrame, cities: DataFrame, cell_km: float = CELL_KM) -> DataFrame:
    """Edges of each zone's cell."""
    c = F.col
    return zones.join(small_side(cities), "city").select(
        *zones.columns, *cell_box(c("cx"), c("cy"), c("lat_c"), c("lon_c"), c("dlat"), c("dlon"), cell_km))


def in_zones(updates: DataFrame, zoned: DataFrame) -> DataFrame:
    """Stop updates with their zone (and, where updates name one, only of the city's own operator).

    The stop register is broadcast when its counted size allows.
    """
    on = ["stop_id", *(["operator"] if "operator" in updates.columns else [])]
    return updates.join(small_side(zoned.select(*on, "city", "zone_id").distinct()), on)


def _per_stop(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates combined per stop, so a join sees one row per stop and key, not every update."""
    own = ["operator"] if "operator" in updates.columns else []
    return updates.groupBy(*keys, *own, "stop_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("arrival_delay").alias("_sum"), F.count("arrival_delay").alias("_obs"))


def zone_activity(updates: DataFrame, zoned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whole-window zone metrics: updates, mean delay and its observations (nulls ignored)."""
    return in_zones(_per_stop(updates, keys), zoned).groupBy(*keys, "city", "zone_id").agg(
        F.sum("_n").alias("activity"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_obs")).alias("delay"),
        F.sum("_obs").alias("n_delay_obs"))


def zone_minutes(updates: DataFrame, zoned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Activity and mean delay per zone and minute."""
    return in_zones(_per_stop(updates, [*keys, "minute"]), zoned).groupBy(*keys, "city", "zone_id", "minute").agg(
        F.sum("_n").alias("activity"), F.try_divide(F.sum("_sum").cast("double"), F.sum("_obs")).alias("delay"))


def zone_peak_ratio(minutes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean activity in and out of the rush hour per zone, and their ratio where the latter is positive."""
    peak = is_peak(F.col("minute"))
    busy, calm = F.when(peak, F.col("activity")), F.when(~peak, F.col("activity"))
    return minutes.groupBy(*keys, "city", "zone_id").agg(
        F.avg(busy).alias("mean_peak"), F.avg(calm).alias("mean_offpeak"),
        F.count(busy).alias("n_peak_minutes"), F.count(calm).alias("n_offpeak_minutes"),
        F.when(F.avg(calm) > 0, F.try_divide(F.avg(busy), F.avg(calm))).alias("ratio"))


def zones_with_metrics(zones: DataFrame, metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every zone in every window, with its metrics or nulls."""
    if not keys:
        return zones.join(metrics.drop("city"), "zone_id", "left")
    windows = metrics.select(*keys, "city").distinct()
    frame = zones.join(windows, "city")
    return frame.join(metrics.drop("city"), [*keys, "zone_id"], "left")
