"""Normalizers: raw feed rows to the declared normalized columns.

All of them are projections (plus one grouped maximum for trips and one count for
situations), so they run inside the scan stage. File columns added by the scan are kept
for the deduplication that follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.fixed import (
    METRIC_VALUE_ORDER,
    SITUATION_LOCATION_NEEDLES,
    SITUATION_LOCATION_STOPS,
    SITUATION_TIME_NEEDLES,
    SITUATION_TYPE_NEEDLES,
    SOURCE_LABELS,
)
from urbanpulse.functions.nested import field_path, first_match, last_match, optional, top
from urbanpulse.functions.rounding import rounded
from urbanpulse.functions.times import (
    after_2000,
    as_instant,
    bucket,
    date_epoch,
    iso_timestamp,
    minutes_between,
    service_departure,
    snapshot_epoch,
)
from urbanpulse.sources.schemas import NORMALIZED
from urbanpulse.sources.snapshots import FILE, FILE_TIME, FOLDER_DATE, ROW

FILE_COLUMNS = (FILE, FILE_TIME, ROW, FOLDER_DATE)


def carried(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in FILE_COLUMNS if c in df.columns]


def empty(df: DataFrame, feed: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], NORMALIZED[feed])


def normalize_flights(df: DataFrame) -> DataFrame:
    """Parse both times to UTC and derive the delay in minutes; missing columns become typed nulls."""
    def text(name: str) -> Column:
        return optional(df, name, "string")

    scheduled = iso_timestamp(text("schedule_time"))
    actual = iso_timestamp(text("status_time"))
    return df.select(
        text("airline"), text("flight_id"), text("airport"), text("schedule_time"),
        text("airport").alias("location"),
        text("status").alias("metric_value"),
        scheduled.alias("timestamp"),
        text("arr_dep").alias("metric_name"),
        F.lit(SOURCE_LABELS["flights"]).alias("source"),
        actual.alias("status_time"),
        text("delayed"),
        minutes_between(actual, scheduled).alias("delay_minutes"),
        text("uniqueID"),
        *carried(df),
    )


def normalize_bikes(df: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Bikes in use: capacity minus bikes at the dock; without a capacity table, free docks.

    The station table joins by size: Spark broadcasts it below its threshold and
    otherwise shuffles, splitting a hot station.
    """
    if stations is not None:
        df = df.drop("capacity").join(stations.select("station_id", "capacity"), "station_id", "left")
        in_use = F.col("capacity") - F.col("num_bikes_available")
    else:
        in_use = F.col("num_docks_available")
    return df.select(
        F.col("station_id").alias("location"),
        in_use.cast("double").alias("metric_value"),
        "num_bikes_available", "num_docks_available", "is_renting", "is_returning",
        F.timestamp_seconds(F.col("last_reported")).alias("timestamp"),
        F.lit(SOURCE_LABELS["bikes"]).alias("source"),
        optional(df, "capacity", "bigint"),
        optional(df, "is_installed", "boolean"),
        optional(df, "num_vehicles_available", "bigint"),
        *carried(df),
    )


def station_capacity(info: DataFrame) -> DataFrame:
    """Capacity per station from the newest information file; the last duplicate wins."""
    from urbanpulse.sources.snapshots import rows_of_latest_file

    rows = rows_of_latest_file(info) if FILE in info.columns else info
    order = F.col(ROW) if ROW in info.columns else F.monotonically_increasing_id()
    return rows.groupBy("station_id").agg(F.max_by("capacity", order).alias("capacity"))


# Paths of the measured values inside a quantity's basic data.
WEATHER_PATHS = {
    "road_temperature": ("ns10:roadSurfaceConditionMeasurements", "roadSurfaceTemperature", "temperature"),
    "air_temperature": ("ns10:temperature", "airTemperature", "temperature"),
    "precipitation_intensity": (
        "ns10:precipitationDetail", "precipitationIntensity", "millimetresPerHourIntensity"),
    "wind_speed": ("ns10:wind", "windSpeed", "windSpeed"),
    "wind_direction_bearing": ("ns10:wind", "windDirectionBearing", "directionBearing"),
    "max_wind_speed": ("ns10:wind", "maximumWindSpeed", "windSpeed"),
    "relative_humidity": ("ns10:humidity", "relativeHumidity", "percentage"),
    "dew_point_temperature": ("ns10:temperature", "dewPointTemperature", "temperature"),
}


def weather_values(df: DataFrame) -> DataFrame:
    """Keep rows with any measured value and add `metric_value`, the first present of seven.

    The wind bearing keeps a row alive but never becomes its metric value.
    """
    measured = [F.col(c) for c in WEATHER_PATHS]
    first = F.coalesce(*[F.col(c) for c in METRIC_VALUE_ORDER])
    return df.where(F.coalesce(*measured).isNotNull()).withColumn("metric_value", first)


def normalize_road_weather(df: DataFrame) -> DataFrame:
    """One row per measured quantity of a site, eight optional values each."""
    quantities, clock = "ns10:physicalQuantity", "ns10:measurementTimeDefault.ns10:timeValue"
    if quantities not in df.columns or clock not in df.columns:
        return empty(df, "road_weather")
    item = df.schema[quantities].dataType.elementType
    q = F.col("_q")
    rows = df.select(
        optional(df, "ns10:measurementSiteReference.@id", "string").alias("location"),
        iso_timestamp(top(clock), fraction=True).alias("timestamp"),
        F.explode(top(quantities)).alias("_q"),
        *carried(df),
    )
    inner = (quantities, "ns10:basicData")
    values = rows.withColumns(
        {name: field_path(q, item, (*inner, *path)).try_cast("double") for name, path in WEATHER_PATHS.items()}
    )
    kept = weather_values(values)
    return kept.select(
        "location",
        field_path(q, item, ("@index",)).alias("metric_name"),
        "metric_value", "timestamp",
        F.lit(SOURCE_LABELS["road_weather"]).alias("source"),
        *WEATHER_PATHS,
        field_path(q, item, (quantities, "@xsi:type")).alias("measurement_type"),
        *carried(kept),
    )


def normalize_travel_times(df: DataFrame) -> DataFrame:
    """One row per road section: period, free-flow time and speed, status."""
    name = "ns2:messageContainer.ns2:payload.ns10:physicalQuantity"
    if name not in df.columns:
        return empty(df, "travel_times")
    item = df.schema[name].dataType.elementType
    q = F.col("_q")

    def at(*path: str) -> Column:
        return field_path(q, item, path)

    def basic(*path: str) -> Column:
        return at("ns10:basicData", *path)

    period = ("ns10:measurementOrCalculationTime", "ns10:period")
    rows = df.select(F.explode_outer(top(name)).alias("_q"), *carried(df))
    return rows.select(
        at("ns10:pertinentLocation", "ns8:predefinedLocationReference", "@id").alias("location_id"),
        iso_timestamp(basic(*period, "startOfPeriod"), fraction=True).alias("period_start"),
        iso_timestamp(basic(*period, "endOfPeriod"), fraction=True).alias("period_end"),
        basic("ns10:freeFlowTravelTime", "ns10:duration").try_cast("double").alias("free_flow_travel_time_sec"),
        basic("ns10:freeFlowSpeed", "speed").try_cast("double").alias("free_flow_speed_kmh"),
        basic("ns10:trafficStatus", "ns10:trafficStatusValue").alias("traffic_status"),
        F.lit(SOURCE_LABELS["travel_times"]).alias("source"),
        *carried(rows),
    )


def situation_columns(names: list[str]) -> dict[str, str | None]:
    """Which columns of a flattened record hold its time, type and location, decided on names alone."""
    return {
        "time": first_match(names, SITUATION_TIME_NEEDLES),
        "type": first_match(names, SITUATION_TYPE_NEEDLES),
        "location": last_match(names, SITUATION_LOCATION_NEEDLES, SITUATION_LOCATION_STOPS),
    }


def normalize_situations(df: DataFrame, snapshot: tuple[str, ...] | None = None,
                         dedup_snapshots: bool = False) -> DataFrame:
    """Event counts per minute, type and (where a snapshot has more than one) location.

    A situation is counted again in every snapshot that reports it; `dedup_snapshots` counts
    each (minute, type, location) once instead.
    """
    found = situation_columns([c for c in df.columns if c not in FILE_COLUMNS])
    if found["time"] is None:
        return empty(df, "situations")
    if snapshot is None:
        snapshot = tuple(c for c in (FOLDER_DATE, FILE) if c in df.columns)
    clock = top(found["time"])
    if isinstance(df.schema[found["time"]].dataType, T.StringType):
        clock = iso_timestamp(clock, fraction=True)
    else:
        clock = as_instant(clock)
    kind = F.coalesce(top(found["type"]).cast("string"), F.lit("unknown")) if found["type"] else F.lit("unknown")
    place = F.coalesce(top(found["location"]).cast("string"), F.lit("")) if found["location"] else F.lit("")
    rows = df.select(
        *[F.col(c) for c in snapshot], bucket(clock).alias("minute"),
        kind.alias("situation_type"), place.alias("location_id"),
    )
    keys = [*snapshot, "minute", "situation_type"]
    counted = rows.groupBy(*keys, "location_id").agg(F.count(F.lit(1)).alias("event_count"))
    # a snapshot with a single location carries none
    if snapshot:
        spread = counted.groupBy(*snapshot).agg((F.min("location_id") < F.max("location_id")).alias("_many"))
        counted = counted.join(spread, list(snapshot))
    else:
        many = counted.select((F.min("location_id") < F.max("location_id")).alias("_many")).scalar()
        counted = counted.withColumn("_many", many)
    out = counted.withColumn("location_id", F.when(F.col("_many"), F.col("location_id")))
    if dedup_snapshots:
        out = out.select("minute", "situation_type", "location_id").distinct().withColumn(
            "event_count", F.lit(1).cast("bigint"))
    return out.select(
        F.date_format("minute", "yyyy-MM-dd").alias("date"), "minute", "situation_type",
        F.col("location_id").cast("string").alias("location_id"), "event_count",
        F.lit(SOURCE_LABELS["situations"]).alias("source"),
        *[F.col(c) for c in snapshot if c in out.columns],
    )


def trip_delays(df: DataFrame) -> DataFrame:
    """Largest arrival and departure delay of each trip row; an absent delay counts as 0.

    The array is reduced inside its row, so updates are never exploded, and the grouped
    maximum that follows is combined before the shuffle. A trip without updates has delay 0.
    """
    item = df.schema["stop_time_updates"].dataType.elementType
    fields = item.fieldNames() if isinstance(item, T.StructType) else []
    updates = F.col("stop_time_updates")

    def largest(name: str) -> Column:
        if name not in fields:
            return F.lit(0).cast("bigint")
        worst = F.array_max(F.transform(updates, lambda u: F.coalesce(u[name].cast("bigint"), F.lit(0))))
        return F.coalesce(worst, F.lit(0)).cast("bigint")

    clock = [F.coalesce(F.col("start_time").cast("string"), F.lit("")).alias("start_time")] \
        if "start_time" in df.columns else []
    day = [F.col("start_date").cast("string").alias("start_date")] if "start_date" in df.columns else []
    keys = ["trip_id", "route_id", "timestamp"] + [c for c in ("start_date", "start_time") if c in df.columns]
    origin = [c for c in (FILE, FILE_TIME, FOLDER_DATE) if c in df.columns]
    per_row = df.select(
        "trip_id", "route_id", "timestamp", *day, *clock, *origin,
        largest("arrival_delay").alias("_arrival"), largest("departure_delay").alias("_departure"),
        F.coalesce(F.size(updates), F.lit(0)).alias("_updates"),
    )
    return per_row.groupBy(*keys, *origin).agg(
        F.max("_arrival").alias("max_arrival_delay_sec"),
        F.max("_departure").alias("max_departure_delay_sec"),
        F.sum(F.greatest(F.col("_updates"), F.lit(0))).alias("n_stop_updates"),
    )


def trip_times(df: DataFrame, service_tz: str | None = None) -> DataFrame:
    """Departure epoch from service date and clock; a missing or zero timestamp takes the departure."""
    if "start_date" in df.columns:
        clock = F.col("start_time") if "start_time" in df.columns else F.lit(None).cast("string")
        departure = service_departure(F.col("start_date"), clock, service_tz)
    else:
        departure = F.lit(None).cast("bigint")
    own = F.col("timestamp").try_cast("bigint")
    df = df.withColumn("departure_timestamp", departure)
    return df.withColumn(
        "timestamp", F.when(F.coalesce(own, F.lit(0)) == 0, F.col("departure_timestamp")).otherwise(own)
    )


def fill_epochs(df: DataFrame, fallback: Column) -> DataFrame:
    """Replace epochs not after 2000: departure by the fallback, timestamp by the departure."""
    departure = F.when(after_2000(F.col("departure_timestamp")), F.col("departure_timestamp").try_cast("bigint"))
    df = df.withColumn("departure_timestamp", F.coalesce(departure, fallback))
    own = F.when(after_2000(F.col("timestamp")), F.col("timestamp").try_cast("bigint"))
    return df.withColumn("timestamp", F.coalesce(own, F.col("departure_timestamp")))


def normalize_trips(df: DataFrame, service_tz: str | None = None) -> DataFrame:
    """Trip delays and times; epochs that cannot be right come from the snapshot's name or folder."""
    out = trip_times(trip_delays(df), service_tz)
    if FOLDER_DATE in out.columns:
        day = F.col(FOLDER_DATE)
        out = fill_epochs(out, F.coalesce(snapshot_epoch(day, F.col(FILE)), date_epoch(day)))
    names = [f.name for f in NORMALIZED["trips"].fields]
    return out.select(
        *[optional(out, n, NORMALIZED["trips"][n].dataType.simpleString()) for n in names],
        "n_stop_updates", *carried(out),
    )


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "flights": normalize_flights,
    "bikes": normalize_bikes,
    "road_weather": normalize_road_weather,
    "travel_times": normalize_travel_times,
    "situations": normalize_situations,
    "trips": normalize_trips,
}

OWN_DATE_COLUMN = {"road_weather": "timestamp", "situations": "minute"}


def own_date_only(df: DataFrame, time_column: str, date_column: str = FOLDER_DATE) -> DataFrame:
    """Rows whose own time falls on the date of their folder; rows without a time are dropped."""
    return df.where(F.col(time_column).cast("date") == F.col(date_column))


def zero_timestamp_share(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many raw rows carry timestamp 0."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("timestamp") == 0).alias("n_zero"),
        rounded(F.try_divide(F.count_if(F.col("timestamp") == 0) * 100.0, F.count(F.lit(1))), 4).alias("pct_zero"),
    )
