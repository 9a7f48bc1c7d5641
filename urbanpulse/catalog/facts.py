"""Activity, fact table, index and time-window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import (
    EV,
    INDEX,
    JANUARY,
    OVERLAPPING,
    PERIOD_TEST,
    clock,
    events,
    fact_sql,
    feeds,
    index_sql,
    periods_sql,
    r6,
    table,
)
from urbanpulse.fixed import INDEX_VARIANTS, days
from urbanpulse.functions.times import plausible_epoch
from urbanpulse.operators.minute_fact import (
    coverage,
    minute_fact,
    temperature_summary,
    weather_minutes,
    with_index,
    with_variants,
    with_zone,
)
from urbanpulse.operators.periods import effective_time, in_window, with_period_table, with_periods
from urbanpulse.plans.impact import period_fact
from urbanpulse.sources.snapshots import profile

register = Register()

FACT_ROUNDED = """CAST(strftime(minute, '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS minute,
  round(road_temperature, 6) AS road_temperature, round(precipitation_intensity, 6) AS precipitation_intensity,
  round(wind_speed, 6) AS wind_speed, round(relative_humidity, 6) AS relative_humidity,
  round(bikes_in_use, 6) AS bikes_in_use, public_transport_activity, flight_activity,
  round(mean_delay_sec, 6) AS mean_delay_sec, round(mean_arrival_delay_sec, 6) AS mean_arrival_delay_sec,
  round(mean_travel_time_sec, 6) AS mean_travel_time_sec, round(mean_speed_kmh, 6) AS mean_speed_kmh,
  traffic_incident_count"""
MEASURES = ("road_temperature", "precipitation_intensity", "wind_speed", "relative_humidity", "bikes_in_use",
            "mean_delay_sec", "mean_arrival_delay_sec", "mean_travel_time_sec", "mean_speed_kmh")
COUNTS = ("public_transport_activity", "flight_activity", "traffic_incident_count")


def fact_columns(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.select(*keys, clock(F.col("minute")), *[r6(F.col(c), c) for c in MEASURES], *COUNTS)


@register(f"WITH {EV} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, event_type AS mode, "
          "CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM ev GROUP BY ALL")
def minute_activity(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.date_trunc("minute", "ts").alias("m"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select(clock(F.col("m")), F.col("event_type").alias("mode"), "n", r6(F.col("total"), "total"))


@register(f"{fact_sql('hour')} SELECT {FACT_ROUNDED} FROM fact")
def hourly_fact(spark: SparkSession, sf: str) -> DataFrame:
    return fact_columns(minute_fact(feeds(events(spark, sf)), unit="hour"))


@register(f"{fact_sql('minute')} SELECT {FACT_ROUNDED} FROM fact")
def minute_fact_table(spark: SparkSession, sf: str) -> DataFrame:
    return fact_columns(minute_fact(feeds(events(spark, sf))))


@register(f"{fact_sql('hour', OVERLAPPING)} SELECT period, {FACT_ROUNDED} FROM fact")
def period_fact_table(spark: SparkSession, sf: str) -> DataFrame:
    return fact_columns(period_fact(feeds(events(spark, sf)), OVERLAPPING, "hour"), "period")


@register(f"{fact_sql('minute')} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, "
          "round(road_temperature, 6) AS road_temperature, round(wind_speed, 6) AS wind_speed FROM w")
def temperature_minutes(spark: SparkSession, sf: str) -> DataFrame:
    out = weather_minutes(feeds(events(spark, sf))["road_weather"])
    return out.select(clock(F.col("minute")), r6(F.col("road_temperature"), "road_temperature"),
                      r6(F.col("wind_speed"), "wind_speed"))


@register(f"""WITH {EV} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS minute,
  'n' || c_nationkey AS zone, round(avg(value), 6) AS road_temperature, round(avg(k / 10.0), 6) AS precipitation_intensity
  FROM ev JOIN customer ON c_custkey = user_id
  WHERE event_type = 'view' AND value BETWEEN -50 AND 50 GROUP BY ALL""")
def zone_weather(spark: SparkSession, sf: str) -> DataFrame:
    mapping = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("location"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("zone"))
    zoned = with_zone(feeds(events(spark, sf))["road_weather"], mapping).where(F.col("zone").isNotNull())
    out = weather_minutes(zoned, ("zone",), "hour")
    return out.select(clock(F.col("minute")), "zone", r6(F.col("road_temperature"), "road_temperature"),
                      r6(F.col("precipitation_intensity"), "precipitation_intensity"))


@register(f"{fact_sql('hour')} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, "
          f"round({index_sql(INDEX)}, 6) AS multimodal_activity FROM fact")
def multimodal_index(spark: SparkSession, sf: str) -> DataFrame:
    out = with_index(minute_fact(feeds(events(spark, sf)), unit="hour"))
    return out.select(clock(F.col("minute")), r6(F.col("multimodal_activity"), "multimodal_activity"))


@register(f"{fact_sql('hour', JANUARY)} SELECT period, strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, "
          f"round({index_sql(INDEX_VARIANTS['bike_pt'], 'PARTITION BY period')}, 6) AS bike_pt, "
          f"round({index_sql(INDEX_VARIANTS['bike_pt_flight'], 'PARTITION BY period')}, 6) AS bike_pt_flight FROM fact")
def index_variants(spark: SparkSession, sf: str) -> DataFrame:
    fact = period_fact(feeds(events(spark, sf)), JANUARY, "hour")
    out = with_variants(fact, INDEX_VARIANTS, ("period",))
    return out.select("period", clock(F.col("minute")), *[r6(F.col(v), v) for v in INDEX_VARIANTS])


@register(f"""{fact_sql('hour', JANUARY)}, scaled AS (
  SELECT period, minute, {index_sql(INDEX, 'PARTITION BY period')} AS multimodal_activity FROM fact)
SELECT period, strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, round(multimodal_activity, 6) AS multimodal_activity
FROM scaled WHERE extract(hour FROM minute) >= 6 AND extract(hour FROM minute) < 12""")
def part_of_day_index(spark: SparkSession, sf: str) -> DataFrame:
    out = period_fact(feeds(events(spark, sf)), JANUARY, "hour", hours=(6, 12))
    return out.select("period", clock(F.col("minute")), r6(F.col("multimodal_activity"), "multimodal_activity"))


@register(f"""{fact_sql('hour')} SELECT strftime(min(minute), '%Y-%m-%d %H:%M:%S') AS first_minute,
  strftime(max(minute), '%Y-%m-%d %H:%M:%S') AS last_minute, CAST(count(*) AS BIGINT) AS n_minutes,
  CAST(count(bikes_in_use) AS BIGINT) AS n_bikes_in_use, CAST(count(mean_delay_sec) AS BIGINT) AS n_mean_delay_sec,
  CAST(count(flight_activity) AS BIGINT) AS n_flight_activity FROM fact""")
def data_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(minute_fact(feeds(events(spark, sf)), unit="hour")).select(
        "first_minute", "last_minute", "n_minutes", "n_bikes_in_use", "n_mean_delay_sec", "n_flight_activity")


@register(f"""{fact_sql('hour', OVERLAPPING)} SELECT period, round(min(road_temperature), 1) AS min_c,
  round(max(road_temperature), 1) AS max_c, round(avg(road_temperature), 1) AS mean_c,
  round(coalesce(stddev_samp(road_temperature), 0), 1) AS std_c, CAST(count(*) AS BIGINT) AS n_readings
  FROM fact GROUP BY period""")
def temperature_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return temperature_summary(period_fact(feeds(events(spark, sf)), OVERLAPPING, "hour"), ("period",))


@register("""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(ts) AS VARCHAR)[1:19] AS first_time,
  CAST(max(ts) AS VARCHAR)[1:19] AS last_time, min(value) AS min_temperature, max(value) AS max_temperature,
  CAST(count(value) AS BIGINT) AS n_temperature, 5 AS n_columns, 'source' AS missing_columns
  FROM events WHERE event_type = 'view'""")
def weather_profile(spark: SparkSession, sf: str) -> DataFrame:
    weather = feeds(events(spark, sf))["road_weather"].drop("relative_humidity")
    out = profile(weather, "road_weather")
    return out.withColumns({c: F.substring(c, 1, 19) for c in ("first_time", "last_time")})


@register("""SELECT event_type AS mode, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59' GROUP BY event_type""")
def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = days("window", "2024-01-05", "2024-01-20")
    kept = events(spark, sf).where(in_window(F.col("ts"), p.start, p.end))
    return kept.groupBy(F.col("event_type").alias("mode")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))


@register(f"""WITH {EV}, {periods_sql(OVERLAPPING)} SELECT period, event_type AS mode, CAST(count(*) AS BIGINT) AS n,
  round(avg(value), 6) AS mean_value FROM ev JOIN periods ON {PERIOD_TEST} GROUP BY ALL""")
def weekday_weekend(spark: SparkSession, sf: str) -> DataFrame:
    placed = with_periods(events(spark, sf), F.col("ts"), OVERLAPPING)
    return placed.groupBy("period", F.col("event_type").alias("mode")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean_value"))


@register("""WITH years AS (SELECT DISTINCT extract(year FROM o_orderdate) AS y FROM orders)
SELECT CAST(y AS VARCHAR) AS period, l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 6) AS quantity
FROM lineitem JOIN years ON l_shipdate BETWEEN make_timestamp(y, 1, 1, 0, 0, 0) AND make_timestamp(y, 12, 31, 0, 0, 0)
  AND isodow(l_shipdate) <= 5 GROUP BY ALL""")
def long_period_table(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("o_orderdate")
    periods = table(spark, sf, "orders").select(
        year.cast("string").alias("name"), F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start_date"),
        F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("end_date"),
        F.lit(True).alias("weekday_only")).distinct()
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.col("l_shipdate").cast("timestamp").alias("ts"))
    return with_period_table(rows, F.col("ts"), periods).groupBy("period", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), "quantity"))


@register(f"""WITH {EV}, shifted AS (SELECT event_type AS mode, epoch_us(ts) // 1000000 +
    CASE WHEN k % 3 = 0 THEN -1500000000 WHEN k % 3 = 1 THEN 3000000000 ELSE 0 END AS sec FROM ev)
SELECT mode, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (sec BETWEEN 946684800 AND 4102444800) AS BIGINT) AS n_plausible FROM shifted GROUP BY mode""")
def plausible_epochs(spark: SparkSession, sf: str) -> DataFrame:
    shift = F.when(F.col("k") % 3 == 0, -1500000000).when(F.col("k") % 3 == 1, F.lit(3000000000)).otherwise(0)
    rows = events(spark, sf).select(F.col("event_type").alias("mode"), (F.unix_seconds("ts") + shift).alias("sec"))
    return rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(plausible_epoch(F.col("sec"))).alias("n_plausible"))


@register(f"""WITH {EV}, r AS (SELECT ts, CASE WHEN k < 10 THEN 0 ELSE epoch_us(ts) // 1000000 END AS departure
  FROM ev WHERE event_type = 'purchase')
SELECT strftime(date_trunc('day', CASE WHEN departure <> 0 THEN make_timestamp(departure * 1000000) ELSE
    make_timestamp(0) END), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL""")
def trip_effective_day(spark: SparkSession, sf: str) -> DataFrame:
    trips = feeds(events(spark, sf))["trips"].withColumn(
        "departure_timestamp", F.when(F.col("max_arrival_delay_sec") < 10, 0).otherwise(F.col("departure_timestamp")))
    day = F.date_format(effective_time("trips"), "yyyy-MM-dd").alias("day")
    return trips.groupBy(day).agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLES = register.queries, register.oracles
