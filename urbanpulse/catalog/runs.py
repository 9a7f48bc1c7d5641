"""Whole normalization runs over landing files that Spark writes from the event table.

Events play flights: a folder a day, four files in each. The runs meet a crash, a broken page, late files, a re-run that cannot read
all files, and a compaction; SQL says what must be left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.catalog import Register
from urbanpulse.catalog.landing import land
from urbanpulse.catalog.standins import events
from urbanpulse.plans import normalization
from urbanpulse.session import checkpoint_dir, path_bytes, read_bytes, remove, write_bytes
from urbanpulse.sources.commits import begin
from urbanpulse.sources.sinks import plan_runs, read_unread
from urbanpulse.sources.snapshots import read_normalized_table

register = Register()

FEED = "flights"
BROKEN, BROKEN_LATER = ("2024-01-10", 1), ("2024-01-20", 0)


def file_of(folder: str, day: str, number: int) -> str:
    return f"{folder}/{day}/{name_of(number)}"


def name_of(number: int) -> str:
    return f"OSL_{number:02d}0000.parquet"


def spoil(spark: SparkSession, file: str) -> bool:
    """Change the pages of a Parquet file and leave its footer as it is; False if there is no such file."""
    if not path_bytes(spark, file):
        return False
    data = bytearray(read_bytes(spark, file))
    footer = int.from_bytes(data[-8:-4], "little") + 8
    data[4:len(data) - footer] = bytes(b ^ 0x5A for b in data[4:len(data) - footer])
    remove(spark, file)
    write_bytes(spark, file, bytes(data))
    return True


@register(f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id % 4 AS part, event_id, user_id FROM events),
seen AS (SELECT * FROM e WHERE NOT (day = '2024-01-10' AND part = 1)),
bad AS (SELECT DISTINCT day, part FROM e WHERE (day, part) IN (('2024-01-10', 1), ('2024-01-20', 0)))
SELECT day, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT user_id) AS BIGINT) AS n_places, CAST(sum(event_id) AS BIGINT) AS id_sum,
  CAST(coalesce((SELECT count(*) FROM bad WHERE bad.day = seen.day), 0) AS BIGINT) AS n_broken FROM seen GROUP BY day""")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    base = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    raw, out, ledger = f"{base}/raw", f"{base}/normalized", f"{base}/ledger"
    landing = f"{raw}/{normalization.RAW_LAYOUT[FEED][0]}"
    flights = events(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 4).alias("part"), F.col("user_id").cast("string").alias("airport"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("schedule_time"), F.lit(None).cast("string").alias("status_time"),
        F.col("event_id").cast("string").alias("uniqueID"), F.lit("D").alias("arr_dep"))

    def run(**options) -> None:
        normalization.normalize_feed(spark, raw, out, ledger, FEED, all_dates=True, **options)

    for number in (0, 1):
        land(flights.where(F.col("part") == number).drop("part"), landing, name_of(number))
    spoil(spark, file_of(landing, *BROKEN))
    # a run that dies with its plan written and some of its rows
    begin(spark, normalization.table_of(out, FEED))
    files = normalization.new_files(spark, raw, FEED, ledger, None, None, False, True)
    name = plan_runs(files, ledger, FEED, False, "", normalization.RUN_FILES)[0]
    some = [r["key"] for r in files.where(F.col("key").contains("OSL_00")).toLocalIterator()]
    normalization.write_rows(spark, raw, out, FEED, name, some)
    land(flights.where(F.col("part") == 2).drop("part"), landing, name_of(2))
    run()
    land(flights.where(F.col("part") == 3).drop("part"), landing, name_of(3))
    run()
    spoil(spark, file_of(landing, *BROKEN_LATER))
    run(rerun_all=True)
    normalization.compact_feed(spark, out, FEED)
    normalization.sweep_feed(spark, out, ledger, FEED, keep=1)
    table = read_normalized_table(spark, out, FEED)
    broken = read_unread(spark, ledger).where(F.col("reason").contains("could be read") & ~F.col("reason").contains("not replaced"))
    bad = broken.select("key", F.regexp_extract("key", r"/(\d{4}-\d{2}-\d{2})/", 1).alias("day")).distinct().groupBy("day").agg(
        F.count(F.lit(1)).alias("n_broken"))
    days = table.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("location").alias("n_places"), F.sum(F.col("uniqueID").cast("bigint")).alias("id_sum"))
    return days.join(bad, "day", "left").withColumn("n_broken", F.coalesce("n_broken", F.lit(0).cast("bigint")))


QUERIES, ORACLES = register.queries, register.oracles
