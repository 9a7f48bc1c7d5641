"""Writers and the ledger of files already processed."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import WEATHER_SITES
from urbanpulse.functions.times import folder_date
from urbanpulse.session import child_names, path_exists, remove, rename
from urbanpulse.sources.schemas import each, struct

LEDGER = struct(each("source key date"))
PLAN = struct(each("key date")).add("replaces", "boolean")


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Put a table in place of what stands at a fixed path: written beside it, then renamed, so a failed write leaves the old one."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}-{mark}")
    if path_exists(spark, path):
        rename(spark, path, f"{path}-old-{mark}")
    rename(spark, f"{path}-{mark}", path)
    remove(spark, f"{path}-old-{mark}")


def replace_weather_sites(sites: DataFrame, base: str) -> None:
    """The weather-site reference table at its fixed path."""
    replace_table(sites, f"{base.rstrip('/')}/{WEATHER_SITES}")


def read_weather_sites_table(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{WEATHER_SITES}")


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_normalized(df: DataFrame, base: str, run: str, feed: str, date_column: str = "date") -> None:
    """Write one run of a feed under <base>/<feed>/date=/run=; it counts once `commits.add_run` says so.

    Only the partitions of this run are overwritten.
    """
    out = df.withColumns({"run": F.lit(run), "date": F.col(date_column).cast("date")})
    (
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "run").parquet(f"{base.rstrip('/')}/{feed}")
    )


def append_csv(df: DataFrame, path: str) -> None:
    """Append result rows as CSV; each part has a header and nulls are empty."""
    df.write.mode("append").option("header", True).option("nullValue", "").csv(path)


def overwrite_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_ledger(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Files already processed, with their dates where they were told; an absent ledger is empty."""
    if path_exists(spark, path):
        ledger = spark.read.schema(LEDGER).parquet(path)
    else:
        ledger = spark.createDataFrame([], LEDGER)
    return ledger.where(F.col("source") == source) if source else ledger


def mark_processed(files: DataFrame, path: str, source: str) -> None:
    """Add keys to the ledger; keys it holds already are not added again."""
    known = read_ledger(files.sparkSession, path, source)
    date = F.col("date").cast("string") if "date" in files.columns else F.lit(None).cast("string")
    fresh = files.select(F.lit(source).alias("source"), "key", date.alias("date")).dropDuplicates(["key"])
    fresh.join(known, ["source", "key"], "left_anti").write.mode("append").parquet(path)


def plan_runs(files: DataFrame, ledger: str, source: str, replaces: bool, mark: str, most: int) -> list[str]:
    """Write down which files (key, date) each run takes before it begins; returns the runs' names.

    A run takes whole dates, at most `most` files of them unless one date has more, so that a run's file names fit
    the driver. Its name is a digest of its files; runs that replace others add `mark`, so that they never write where rows count.
    """
    spark, names, dates, held = files.sparkSession, [], [], 0

    def plan(own: list) -> None:
        taken = files.where(F.col("date").isin(own))
        names.append(run_name(taken) + (f"-{mark}" if replaces else ""))
        rows = taken.select("key", F.col("date").cast("string").alias("date"), F.lit(replaces).alias("replaces"))
        rows.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}-plans/{source}/{names[-1]}")

    for r in files.groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy("date").toLocalIterator():
        if dates and held + r["n"] > most:
            plan(dates)
            dates, held = [], 0
        dates.append(r["date"])
        held += r["n"]
    if dates:
        plan(dates)
    return names


def open_runs(spark: SparkSession, ledger: str, source: str) -> list[str]:
    """Runs that were planned and did not end; a plan that was not written to its end is none."""
    plans = f"{ledger.rstrip('/')}-plans/{source}"
    return sorted(n for n in child_names(spark, plans) if path_exists(spark, f"{plans}/{n}/_SUCCESS"))


def read_plan(spark: SparkSession, ledger: str, source: str, run: str) -> DataFrame:
    return spark.read.schema(PLAN).parquet(f"{ledger.rstrip('/')}-plans/{source}/{run}")


def write_outcome(files: DataFrame, ledger: str, source: str, run: str) -> None:
    """What became of each file of a run (reason: null if its rows are written), noted before the rows count."""
    rows = files.select("key", "date", "reason")
    rows.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}-outcomes/{source}/{run}")


def read_outcome(spark: SparkSession, ledger: str, source: str, run: str) -> DataFrame | None:
    path = f"{ledger.rstrip('/')}-outcomes/{source}/{run}"
    return spark.read.schema(struct(each("key date reason"))).parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else None


def end_run(spark: SparkSession, ledger: str, source: str, run: str) -> None:
    remove(spark, f"{ledger.rstrip('/')}-plans/{source}/{run}")
    remove(spark, f"{ledger.rstrip('/')}-outcomes/{source}/{run}")


def record_unread(files: DataFrame, ledger: str, source: str, run: str) -> None:
    """Files of a run that gave no rows, with the reason. They stay out of the ledger, so the next run tries them again."""
    rows = files.select(F.lit(source).alias("source"), "key", F.lit(run).alias("run"), "reason")
    rows.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}-unread/{source}/{run}")


def read_unread(spark: SparkSession, ledger: str) -> DataFrame:
    path, schema = f"{ledger.rstrip('/')}-unread", struct(each("source key run reason"))
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def not_processed(files: DataFrame, ledger: DataFrame, rerun_all: bool = False) -> DataFrame:
    """Files the ledger does not hold."""
    return files if rerun_all else files.join(ledger.select("key"), "key", "left_anti")


def with_file_date(files: DataFrame) -> DataFrame:
    return files.withColumn("date", folder_date(F.col("key"), F.col("last_modified")))


def files_by_date(files: DataFrame) -> DataFrame:
    """Files per date. The listing stays one row per file, so no date is gathered into one value."""
    return with_file_date(files).groupBy("date").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("key").alias("first_key"), F.max("key").alias("last_key"),
    )


def merge_listings(*listings: DataFrame) -> DataFrame:
    """Several listings as one, each key once."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["key"])


def in_interval(date: Column, start: str | None = None, end: str | None = None) -> Column:
    """Date filter with open ends; without both it keeps today only."""
    if start is None and end is None:
        return date == F.current_date()
    keep = F.lit(True)
    if start is not None:
        keep = keep & (date >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (date <= F.lit(end).cast("date"))
    return keep


def run_name(keys: DataFrame, names: Iterable[str] = ("key",)) -> str:
    """Name of a run: an order-free digest of its input files."""
    digest = keys.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*names)).alias("x")
    ).first()
    return f"{digest['n']}-{(digest['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"
