"""The per-minute fact table.

Every feed is reduced to (keys, minute, measures) rows, the feeds are stacked and one
grouped aggregation builds the wide table: a single shuffle with map-side combining,
instead of one join per feed. A minute that holds a third of all rows is combined before
it is exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.fixed import OPTIONAL_WEATHER, TEMPERATURE_LIMITS
from urbanpulse.functions.nested import optional
from urbanpulse.functions.rounding import rounded
from urbanpulse.functions.stats import min_max_scaled
from urbanpulse.functions.times import as_instant, bucket, epoch_seconds, plausible_epoch
from urbanpulse.session import materialise

INDEX_COLUMNS = ("bikes_in_use", "public_transport_activity", "flight_activity")


def valid_temperature(value: Column, nonzero: bool = False) -> Column:
    """Present, finite and between the limits; `nonzero` also drops 0, for the fallback column."""
    low, high = TEMPERATURE_LIMITS
    keep = value.isNotNull() & ~F.isnan(value) & value.between(low, high)
    return keep & (value != 0) if nonzero else keep


def weather_rows(weather: DataFrame, keys: Sequence[str] = (), unit: str = "minute", strict: bool = True) -> DataFrame:
    """Temperature and optional measures of valid rows.

    `strict` averages the optional measures only over rows with a valid temperature.
    """
    own = "road_temperature" in weather.columns
    temperature = F.col("road_temperature" if own else "metric_value").try_cast("double")
    valid = valid_temperature(temperature, nonzero=not own)
    measures = [F.col(c).try_cast("double").alias(c) for c in OPTIONAL_WEATHER if c in weather.columns]
    rows = weather.where(valid) if strict else weather
    return rows.select(
        *keys, bucket(as_instant(F.col("timestamp")), unit).alias("minute"),
        F.when(valid, temperature).alias("road_temperature"), *measures,
    )


def weather_minutes(weather: DataFrame, keys: Sequence[str] = (), unit: str = "minute", strict: bool = True) -> DataFrame:
    """Mean temperature and optional measures per minute (and zone or period key)."""
    rows = weather_rows(weather, keys, unit, strict)
    measures = [c for c in OPTIONAL_WEATHER if c in rows.columns]
    out = rows.groupBy(*keys, "minute").agg(
        F.avg("road_temperature").alias("road_temperature"), *[F.avg(c).alias(c) for c in measures])
    return out.where(F.col("road_temperature").isNotNull())


def bike_rows(bikes: DataFrame, keys: Sequence[str] = (), unit: str = "minute") -> DataFrame:
    value = F.col("metric_value").try_cast("double")
    return bikes.where(value.isNotNull()).select(
        *keys, bucket(as_instant(F.col("timestamp")), unit).alias("minute"), value.alias("bikes_in_use"))


def flight_rows(flights: DataFrame, keys: Sequence[str] = (), unit: str = "minute") -> DataFrame:
    return flights.select(
        *keys, bucket(as_instant(F.col("timestamp")), unit).alias("minute"),
        F.lit(1).cast("bigint").alias("flight_activity"))


OWN_ACTIVITY = "_own_activity"


def trip_rows(trips: DataFrame, keys: Sequence[str] = (), unit: str = "minute", clock: str = "auto") -> DataFrame:
    """Activity and delay measures of trips from a single scan.

    Activity counts by departure minute, or by timestamp, as told by `clock`. With "auto" both are counted, the
    second as `_own_activity`, for `by_known_clock` to choose from. Delays sit on the departure, else the timestamp;
    implausible epochs are left out. The places may be different minutes, so a trip gives a row for each.
    """
    departure, own = F.col("departure_timestamp").cast("bigint"), epoch_seconds(F.col("timestamp"))
    activity = own if clock == "own" else departure
    delay = F.when(departure > 0, departure).otherwise(own)

    def row(epoch: Column, count: Column, by_own: Column, late: Column, late_arrival: Column) -> Column:
        return F.struct(
            epoch.alias("epoch"), count.cast("bigint").alias("public_transport_activity"), by_own.cast("bigint").alias(OWN_ACTIVITY),
            late.cast("double").alias("mean_delay_sec"), late_arrival.cast("double").alias("mean_arrival_delay_sec"))

    none = F.lit(None)
    places = [
        row(F.when(activity > 0, activity), F.lit(1), none, none, none),
        row(F.when(plausible_epoch(delay), delay), none, none, F.col("max_departure_delay_sec"),
            optional(trips, "max_arrival_delay_sec", "double"))]
    if clock == "auto":
        places.append(row(F.when(own > 0, own), none, F.lit(1), none, none))
    placed = trips.select(*keys, F.explode(F.array(*places)).alias("r")).where(F.col("r.epoch").isNotNull())
    return placed.select(
        *keys, bucket(F.timestamp_seconds("r.epoch"), unit).alias("minute"), "r.public_transport_activity",
        *([f"r.{OWN_ACTIVITY}"] if clock == "auto" else []), "r.mean_delay_sec", "r.mean_arrival_delay_sec")


def by_known_clock(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transit activity by departure where the key (a period) has any trip with a departure, else by timestamp.

    The table has one row per minute and key, so the calendar bounds the window.
    """
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    known = F.max(F.col("public_transport_activity").isNotNull()).over(whole)
    return wide.withColumn(
        "public_transport_activity", F.when(known, F.col("public_transport_activity")).otherwise(F.col(OWN_ACTIVITY))).drop(OWN_ACTIVITY)


def travel_rows(travel: DataFrame, keys: Sequence[str] = (), unit: str = "minute") -> DataFrame:
    return travel.select(
        *keys, bucket(as_instant(F.col("period_start")), unit).alias("minute"),
        F.col("free_flow_travel_time_sec").alias("mean_travel_time_sec"),
        F.col("free_flow_speed_kmh").alias("mean_speed_kmh"))


def incident_rows(situations: DataFrame, keys: Sequence[str] = (), unit: str = "minute") -> DataFrame:
    return situations.select(
        *keys, bucket(as_instant(F.col("minute")), unit).alias("minute"),
        F.col("event_count").alias("traffic_incident_count"))


SUMMED = {"bikes_in_use": "double", "public_transport_activity": "bigint", "flight_activity": "bigint",
          "traffic_incident_count": "bigint"}
AVERAGED = ("road_temperature", *OPTIONAL_WEATHER, "mean_delay_sec", "mean_arrival_delay_sec",
            "mean_travel_time_sec", "mean_speed_kmh")


def minute_fact(feeds: dict[str, DataFrame], keys: Sequence[str] = (), unit: str = "minute",
                strict: bool = True, clock: str = "auto") -> DataFrame:
    """One row per minute that has weather, with every feed's measures beside it.

    `feeds` maps feed names to normalized tables that carry the key columns (for example
    `period`). The columns of an absent feed are null.
    """
    if "road_weather" not in feeds:
        raise ValueError("the fact table needs road_weather")
    parts = [weather_rows(feeds["road_weather"], keys, unit, strict)]
    if "bikes" in feeds:
        parts.append(bike_rows(feeds["bikes"], keys, unit))
    if "flights" in feeds:
        parts.append(flight_rows(feeds["flights"], keys, unit))
    if "trips" in feeds:
        parts.append(trip_rows(feeds["trips"], keys, unit, clock))
    if "travel_times" in feeds:
        parts.append(travel_rows(feeds["travel_times"], keys, unit))
    if "situations" in feeds:
        parts.append(incident_rows(feeds["situations"], keys, unit))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    always = ("road_temperature", "bikes_in_use", "public_transport_activity", "flight_activity", "mean_delay_sec")
    missing = {c: F.lit(None).cast(SUMMED.get(c, "double")) for c in always if c not in stacked.columns}
    stacked = stacked.withColumns(missing) if missing else stacked
    wide = stacked.groupBy(*keys, "minute").agg(
        *[F.avg(c).alias(c) for c in AVERAGED if c in stacked.columns],
        *[F.sum(c).alias(c) for c in (*SUMMED, OWN_ACTIVITY) if c in stacked.columns],
    )
    if OWN_ACTIVITY in wide.columns:
        wide = by_known_clock(wide, keys)
    return wide.where(F.col("road_temperature").isNotNull())


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _scaled(fact: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The table with the span of each column beside it, and the 0..1 expression of each column.

    The fact is needed twice, for the spans and for itself, so it is written once first: the
    feeds behind it are scanned a single time. Its size is set by minutes, not by the data.
    With keys the spans are joined back on them (one row per period); without, they are a
    scalar subquery.
    """
    fact = materialise(fact)
    ends = {f"_lo_{c}": F.min(_filled(c)) for c in columns} | {f"_hi_{c}": F.max(_filled(c)) for c in columns}
    spans = [e.alias(n) for n, e in ends.items()]
    if keys:
        joined = fact.join(fact.groupBy(*keys).agg(*spans), list(keys))
    else:
        joined = fact.withColumn("_span", fact.agg(F.struct(*spans).alias("s")).scalar())
        joined = joined.withColumns({n: F.col(f"_span.{n}") for n in ends})
    return joined, {c: min_max_scaled(_filled(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in columns}


def with_variants(fact: DataFrame, variants: dict[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Index columns by name: nulls count as 0, each part is scaled to 0..1 per key, parts are added.

    A part that is constant contributes 0; columns the table lacks are skipped.
    """
    present = {name: [c for c in columns if c in fact.columns] for name, columns in variants.items()}
    wanted = sorted({c for columns in present.values() for c in columns})
    if not wanted:
        return fact.withColumns({name: F.lit(None).cast("double") for name in variants})
    joined, scaled = _scaled(fact, wanted, keys)
    return joined.select(*fact.columns, *[
        reduce(lambda a, b: a + b, [scaled[c] for c in columns]).alias(name) if columns
        else F.lit(None).cast("double").alias(name)
        for name, columns in present.items()
    ])


def with_index(fact: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = INDEX_COLUMNS,
               name: str = "multimodal_activity") -> DataFrame:
    """The multimodal index over bikes, transit and flights."""
    return with_variants(fact, {name: columns}, keys)


def with_zone(weather: DataFrame, location_zone: DataFrame) -> DataFrame:
    """Add the zone of a location (left join; Spark broadcasts the mapping by its size)."""
    return weather.join(location_zone.select("location", "zone"), "location", "left")


def records_per_source(feeds: dict[str, DataFrame], unit: str = "minute") -> DataFrame:
    """Per feed its usable records and the minutes they fall in, whether or not those minutes have weather."""
    makers = {"road_weather": weather_rows, "bikes": bike_rows, "flights": flight_rows, "travel_times": travel_rows,
              "situations": incident_rows, "trips": lambda df, keys, unit: trip_rows(df, keys, unit, "own").where("public_transport_activity = 1")}
    parts = [makers[name](df, (), unit).groupBy("minute").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count("minute").alias("n_minutes")).select(
        F.lit(name).alias("source"), "n_records", "n_minutes") for name, df in feeds.items() if name in makers]
    return reduce(lambda a, b: a.unionByName(b), parts)


def coverage(fact: DataFrame) -> DataFrame:
    """First and last minute, minutes, and the minutes each measure covers."""
    measures = [c for c in (*AVERAGED, *SUMMED) if c in fact.columns]
    return fact.agg(
        F.min("minute").cast("string").alias("first_minute"), F.max("minute").cast("string").alias("last_minute"),
        F.count(F.lit(1)).alias("n_minutes"), *[F.count(c).alias(f"n_{c}") for c in measures])


def temperature_summary(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, sample deviation (0 for one reading) and count, rounded to one digit."""
    t = F.when(~F.isnan("road_temperature"), F.col("road_temperature"))
    deviation = F.when(F.count(t) > 1, F.sqrt(F.try_divide(F.var_pop(t) * F.count(t), F.count(t) - 1)))
    return fact.groupBy(*keys).agg(
        rounded(F.min(t), 1).alias("min_c"), rounded(F.max(t), 1).alias("max_c"),
        rounded(F.avg(t), 1).alias("mean_c"),
        rounded(F.coalesce(deviation, F.lit(0.0)), 1).alias("std_c"), F.count(t).alias("n_readings"))
