"""Gaps, throughput and latency, with events as arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.standins import EV, JANUARY, PERIOD_TEST, events, periods_sql, r6, table
from urbanpulse.operators import health
from urbanpulse.plans.reports import health_report

register = Register()

# expected seconds between arrivals
INTERVAL = 300


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_type").alias("source"), F.col("ts").alias("last_modified"))


GAP_STATS = """SELECT {keys}, CAST(any_value(nf) AS BIGINT) AS n_files, CAST(count(g) AS BIGINT) AS n_gaps, round(median(g), 1) AS median_gap_s,
  round(avg(g), 1) AS mean_gap_s, round(quantile_cont(g, 0.95), 1) AS p95_gap_s, round(max(g), 1) AS max_gap_s,
  round(100.0 * count(*) FILTER (g <= 2 * {i}) / count(g), 1) AS pct_within_2x_nominal,
  CAST(count(*) FILTER (g > 10 * {i}) AS BIGINT) AS n_outage_gaps_gt10x, 'ok' AS status FROM gaps GROUP BY {keys}"""


@register("""WITH gaps AS (SELECT event_type AS source, count(*) OVER (PARTITION BY event_type) AS nf,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1e6::DOUBLE AS g FROM events) """
          + GAP_STATS.format(keys="source", i=INTERVAL))
def gap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return health.gap_stats(arrivals(spark, sf), F.lit(INTERVAL))


@register("""WITH gaps AS (SELECT o_orderpriority AS source, count(*) OVER (PARTITION BY o_orderpriority) AS nf,
  (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate)) / 1e6::DOUBLE AS g FROM orders) """
          + GAP_STATS.format(keys="source", i=43200))
def gap_stats_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Many arrivals at the same instant: most gaps are zero."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp").alias("last_modified"))
    return health.gap_stats(rows, F.lit(43200))


@register("""WITH late AS (SELECT event_type AS source, CASE WHEN event_id % 997 = 0 THEN ts + INTERVAL 400 DAY ELSE ts END AS ts FROM events),
  gaps AS (SELECT source, count(*) OVER (PARTITION BY source) AS nf,
  (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source ORDER BY ts)) / 1e6::DOUBLE AS g FROM late) """
          + GAP_STATS.format(keys="source", i=INTERVAL))
def gap_stats_outage(spark: SparkSession, sf: str) -> DataFrame:
    """A year without arrivals: one gap is a hundred thousand times the others."""
    far = F.col("ts") + F.make_dt_interval(F.lit(400))
    rows = events(spark, sf).select(
        F.col("event_type").alias("source"), F.when(F.col("event_id") % 997 == 0, far).otherwise(F.col("ts")).alias("last_modified"))
    return health.gap_stats(rows, F.lit(INTERVAL))


@register("""SELECT source, round(g, 6) AS gap_s, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderstatus AS source,
  (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate)) / 1e6::DOUBLE AS g FROM orders)
WHERE g IS NOT NULL GROUP BY ALL""")
def gap_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderdate").cast("timestamp").alias("last_modified"))
    return health.arrival_gaps(rows).select("source", r6(F.col("gap_s"), "gap_s"), "n")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A file per event type and user-hour: its time is the last event in it."""
    return events(spark, sf).groupBy(
        F.col("event_type").alias("source"), F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd/HH"), F.col("user_id").cast("string")).alias("key")
    ).agg(F.max("ts").alias("last_modified"), F.count(F.lit(1)).alias("n_rows"))


FILES = """files AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d/%H') || '/' || user_id AS key, max(ts) AS last_modified,
  CAST(count(*) AS BIGINT) AS n_rows FROM events GROUP BY ALL)"""


@register(f"""WITH {FILES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_modified, key) AS r,
    count(*) OVER (PARTITION BY source) AS n FROM files),
sampled AS (SELECT source, count(*) AS nf, avg(n_rows) AS mean, median(n_rows) AS med FROM ranked GROUP BY source),
mid AS (SELECT source, any_value(n) AS n, any_value(last_modified) FILTER (r = n // 2 + 1) AS t FROM ranked GROUP BY source),
cyc AS (SELECT source, CASE WHEN any_value(mid.n) >= 20 THEN count(*) FILTER (epoch_us(last_modified) BETWEEN epoch_us(t) AND epoch_us(t) + 5000000 * {INTERVAL}) / 5.0 END AS c
  FROM files JOIN mid USING (source) GROUP BY source)
SELECT source, CAST(nf AS BIGINT) AS n_files_sampled, round(mean, 1) AS mean_records_per_file, round(med, 1) AS median_records_per_file,
  round(mean * 60.0 / {INTERVAL}, 1) AS records_per_min, round(c, 1) AS files_per_cycle, round(mean * c * 60.0 / {INTERVAL}, 1) AS aggregate_records_per_min
FROM sampled JOIN cyc USING (source)""")
def throughput_stats(spark: SparkSession, sf: str) -> DataFrame:
    return health.throughput_stats(files(spark, sf), F.lit(INTERVAL))


@register(f"""WITH {EV}, l AS (SELECT event_type AS source, epoch_us(ts) / 1e6::DOUBLE - (epoch_us(ts) // 1000000 - k * 40 + 100) AS s FROM ev WHERE k <> 50)
SELECT source, CAST(count(*) AS BIGINT) AS n_records, round(median(s), 1) AS median_latency_s, round(avg(s), 1) AS mean_latency_s,
  round(quantile_cont(s, 0.95), 1) AS p95_latency_s, round(max(s), 1) AS max_latency_s FROM l WHERE s >= 0 AND s < 3600 GROUP BY source""")
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("source", F.col("event_type"))
    epoch = F.when(F.col("k") == 50, 0).otherwise(F.unix_seconds("ts") - F.col("k") * 40 + 100)
    return health.latency_stats(health.latencies(rows, epoch, F.col("ts"), ("source",)))


@register(f"""WITH {FILES}, {periods_sql(JANUARY)}, gaps AS (SELECT period, source, count(*) OVER (PARTITION BY period, source) AS nf,
  (epoch_us(last_modified) - lag(epoch_us(last_modified)) OVER (PARTITION BY period, source ORDER BY last_modified)) / 1e6::DOUBLE AS g
  FROM files JOIN periods ON {PERIOD_TEST.replace('ts', 'last_modified')}) """ + GAP_STATS.format(keys="period, source", i=INTERVAL))
def health_by_window(spark: SparkSession, sf: str) -> DataFrame:
    return health_report(spark, files(spark, sf), JANUARY, F.lit(INTERVAL))["robustness"]


QUERIES, ORACLES = register.queries, register.oracles
