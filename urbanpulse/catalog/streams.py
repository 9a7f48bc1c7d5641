"""The event table as a stream, drained with the available-now trigger and read back.

Each query must equal its batch result, which is what the SQL computes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import EV, clock, events, r6, table
from urbanpulse.session import checkpoint_dir, utc
from urbanpulse.streaming import feeds as s

register = Register()

LATE = "60 days"


def stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    raw = utc(spark).readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return raw.withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("bigint")})


def run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@register("""SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, event_type, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def stream_minute_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = run_folder(spark)
    counts = s.minute_counts(stream(spark, sf), F.col("ts"), ["event_type"], LATE)
    s.run_available(counts, f"{out}/data", f"{out}/checkpoint", "update", merge=s.newest(["window_start", "event_type"]))
    now = s.latest(spark, f"{out}/data", ["window_start", "event_type"])
    return now.select(clock(F.col("window_start")), "event_type", "n")


@register("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    out, keys, order = run_folder(spark), ["user_id", "day"], ["ts", "event_id"]
    rows = stream(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    s.run_available(rows, f"{out}/data", f"{out}/checkpoint", each=s.last_seen_batch(keys, order), merge=s.newest(keys, order))
    return s.last_seen(spark, f"{out}/data", keys, order).select("user_id", "day", "event_id", "event_type")


@register("SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    out = run_folder(spark)
    once = s.first_seen(stream(spark, sf), F.col("ts"), ["user_id", "event_type"], LATE)
    s.run_available(once, f"{out}/data", f"{out}/checkpoint")
    return s.read_batches(spark, f"{out}/data").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT event_type, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(ts, '%Y-%m-%d %H:%M:%S') AS until, round(gap, 6) AS gap_s FROM (
  SELECT event_type, ts, lag(ts) OVER w AS since, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE AS gap
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)) WHERE gap > 3600""")
def stream_gap_alarms(spark: SparkSession, sf: str) -> DataFrame:
    out = run_folder(spark)
    each = s.gap_alarms(["event_type"], "ts", F.lit(360), f"{out}/state", lateness=LATE)
    for part in landed_by_lateness(spark, sf, f"{out}/landing"):
        part()
        s.run_available(s.stream_snapshots(spark, f"{out}/landing", events(spark, sf).schema), f"{out}/data", f"{out}/checkpoint", each=each)
    now = s.standing_alarms(spark, f"{out}/data", ["event_type"]).where("until IS NOT NULL")
    return now.select("event_type", clock(F.col("since"), "since"), clock(F.col("until"), "until"), r6(F.col("gap_s"), "gap_s"))


def landed_by_lateness(spark: SparkSession, sf: str, folder: str):
    """Steps that land the events: two thirds of them, then those that come late by up to the whole span."""
    ev = events(spark, sf)
    late = F.pmod(F.hash("event_id"), F.lit(3)) == 0
    return [lambda keep=keep: ev.where(keep).write.mode("append").parquet(folder) for keep in (~late, late)]


@register("""SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, event_type, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL""")
def stream_counts_with_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A third of all events arrive up to a month after the others; those behind the watermark are added afterwards."""
    out, keys = run_folder(spark), ["event_type"]
    partial = s.minute_partials("ts", keys)
    each = s.on_time("ts", f"{out}/late", "2 hours", partial)
    for part in landed_by_lateness(spark, sf, f"{out}/landing"):
        part()
        s.run_available(s.stream_snapshots(spark, f"{out}/landing", events(spark, sf).schema), f"{out}/data", f"{out}/checkpoint",
                        each=each, merge=s.summed(["minute", *keys]))
    s.add_late_rows(spark, f"{out}/data", f"{out}/late", partial)
    now = s.summed(["minute", *keys])(s.read_batches(spark, f"{out}/data"))
    return now.select(clock(F.col("minute")), "event_type", "n")


@register(f"""WITH {EV}, slots AS (SELECT date_trunc('hour', ts) + to_hours(CAST(d AS INTEGER)) AS window_end, event_type, k >= 90 AS flag
  FROM ev, range(1, 25) AS r(d))
SELECT strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, round(avg(CAST(flag AS DOUBLE)), 6) AS density,
  CAST(count(*) AS BIGINT) AS n FROM slots GROUP BY ALL""")
def stream_rolling_density(spark: SparkSession, sf: str) -> DataFrame:
    out = run_folder(spark)
    density = s.rolling_density(stream(spark, sf), F.col("ts"), F.col("k") >= 90, ["event_type"], LATE)
    s.run_available(density, f"{out}/data", f"{out}/checkpoint", "update", merge=s.newest(["window_end", "event_type"]))
    now = s.latest(spark, f"{out}/data", ["window_end", "event_type"])
    return now.select(clock(F.col("window_end"), "window_end"), "event_type", r6(F.col("density"), "density"), "n")


QUERIES, ORACLES = register.queries, register.oracles
