"""The driver tables seen as mobility feeds, in Spark and in SQL.

There are no mobility feeds among the driver tables, so the event stream plays them: an
event type per feed, whole tables throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import Period, days
from urbanpulse.functions.rounding import rounded
from urbanpulse.session import utc

JANUARY = (
    days("Week 1", "2024-01-01", "2024-01-08"),
    days("Week 2", "2024-01-09", "2024-01-16"),
    days("Week 3", "2024-01-17", "2024-01-24"),
    days("Week 4", "2024-01-25", "2024-01-31"),
)
OVERLAPPING = (
    *JANUARY,
    days("Weekdays", "2024-01-01", "2024-01-31", weekday_only=True),
    days("Weekend", "2024-01-01", "2024-01-31", weekend_only=True),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an instant and the number inside their JSON properties."""
    return table(spark, sf, "events").withColumns({
        "ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("bigint")})


def r6(column: Column, name: str) -> Column:
    return rounded(column, 6).alias(name)


def clock(column: Column, name: str = "minute") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)


def feeds(ev: DataFrame) -> dict[str, DataFrame]:
    """Normalized feeds, one event type each (errors are both flights and incidents)."""
    def of(kind: str) -> DataFrame:
        return ev.where(F.col("event_type") == kind)

    epoch = F.unix_seconds("ts")
    return {
        "road_weather": of("view").select(
            F.col("user_id").cast("string").alias("location"), F.col("ts").alias("timestamp"),
            F.col("value").alias("road_temperature"), (F.col("k") / 10.0).alias("precipitation_intensity"),
            (F.col("user_id") / 10.0).alias("wind_speed"), (F.col("value") * F.col("k") / 10.0).alias("relative_humidity")),
        "bikes": of("click").select(F.col("ts").alias("timestamp"), F.col("value").alias("metric_value")),
        "flights": of("error").select(F.col("ts").alias("timestamp")),
        "trips": of("purchase").select(
            epoch.alias("timestamp"), epoch.alias("departure_timestamp"),
            F.floor("value").alias("max_departure_delay_sec"), F.col("k").alias("max_arrival_delay_sec")),
        "travel_times": of("signup").select(
            F.col("ts").alias("period_start"), F.col("value").alias("free_flow_travel_time_sec"),
            F.col("k").cast("double").alias("free_flow_speed_kmh")),
        "situations": of("error").select(
            F.date_trunc("minute", "ts").alias("minute"), F.lit(1).cast("bigint").alias("event_count")),
    }


# ---- the same in SQL ---------------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""


def periods_sql(periods: tuple[Period, ...]) -> str:
    rows = ", ".join(
        f"('{p.name}', TIMESTAMP '{p.start:%Y-%m-%d %H:%M:%S}', TIMESTAMP '{p.end:%Y-%m-%d %H:%M:%S}', "
        f"{'true' if p.weekday_only else 'false'}, {'true' if p.weekend_only else 'false'})" for p in periods)
    return f"periods(period, lo, hi, wd, we) AS (VALUES {rows})"


PERIOD_TEST = "ts BETWEEN lo AND hi AND (NOT wd OR isodow(ts) <= 5) AND (NOT we OR isodow(ts) >= 6)"


def fact_sql(unit: str = "hour", periods: tuple[Period, ...] | None = None) -> str:
    """WITH body that ends in `fact`; with periods the rows are keyed by `period` as well."""
    key = "period, " if periods else ""
    using = "(period, minute)" if periods else "(minute)"
    if periods:
        source = f"{periods_sql(periods)}, src AS (SELECT period, ev.* FROM ev JOIN periods ON {PERIOD_TEST})"
    else:
        source = "src AS (SELECT * FROM ev)"
    m = f"{key}date_trunc('{unit}', ts) AS minute"
    # trips and incidents are placed by whole seconds or minutes before the period test
    group = "GROUP BY ALL"
    return f"""WITH {EV}, {source},
w AS (SELECT {m}, avg(value) AS road_temperature, avg(k / 10.0) AS precipitation_intensity,
             avg(user_id / 10.0) AS wind_speed, avg(value * k / 10.0) AS relative_humidity
      FROM src WHERE event_type = 'view' AND value BETWEEN -50 AND 50 {group}),
b AS (SELECT {m}, sum(value) AS bikes_in_use FROM src WHERE event_type = 'click' {group}),
f AS (SELECT {m}, CAST(count(*) AS BIGINT) AS flight_activity FROM src WHERE event_type = 'error' {group}),
p AS (SELECT {m}, CAST(count(*) AS BIGINT) AS public_transport_activity, avg(floor(value)) AS mean_delay_sec,
             avg(k) AS mean_arrival_delay_sec
      FROM src WHERE event_type = 'purchase' {group}),
t AS (SELECT {m}, avg(value) AS mean_travel_time_sec, avg(k) AS mean_speed_kmh
      FROM src WHERE event_type = 'signup' {group}),
base AS (SELECT * FROM w LEFT JOIN b USING {using} LEFT JOIN f USING {using} LEFT JOIN p USING {using}
         LEFT JOIN t USING {using}),
fact AS (SELECT *, flight_activity AS traffic_incident_count FROM base)"""


def scaled_sql(column: str, over: str = "") -> str:
    """0..1 scaling of a column of `fact` with nulls as 0."""
    v = f"coalesce(CAST({column} AS DOUBLE), 0.0)"
    return (f"CASE WHEN max({v}) OVER ({over}) > min({v}) OVER ({over}) THEN ({v} - min({v}) OVER ({over})) / "
            f"(max({v}) OVER ({over}) - min({v}) OVER ({over})) ELSE 0.0 END")


def index_sql(columns: tuple[str, ...], over: str = "") -> str:
    return " + ".join(scaled_sql(c, over) for c in columns)


INDEX = ("bikes_in_use", "public_transport_activity", "flight_activity")


def corr_sql(x: str, y: str) -> str:
    """Correlation of complete pairs, null for a constant column."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    px, py = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END"
    return (f"CASE WHEN max({px}) > min({px}) AND max({py}) > min({py}) THEN "
            f"covar_pop({py}, {px}) / nullif(stddev_pop({px}) * stddev_pop({py}), 0) END")


PEAK = "(isodow(minute) <= 5 AND extract(hour FROM minute) IN (7, 8, 9, 15, 16, 17))"
