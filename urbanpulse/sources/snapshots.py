"""Readers over landing folders of timestamped snapshot files, and their listings."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.fixed import FILE_NAME_TESTS, RAW_LAYOUT, REQUIRED_COLUMNS
from urbanpulse.functions.times import bucket, folder_date
from urbanpulse.session import child_names, path_exists, utc
from urbanpulse.sources.commits import parts, read_parts, versions
from urbanpulse.sources.schemas import NORMALIZED, RAW

FILE = "_file"
FILE_TIME = "_file_time"
ROW = "_row"
FOLDER_DATE = "_folder_date"


def plain_path(path: Column) -> Column:
    """A path as file listings spell it: `_metadata` gives it URL-encoded and with empty authority."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def with_file_columns(df: DataFrame, row_index: bool = True) -> DataFrame:
    """Add where each row came from: path, modification time, in-file position and folder date.

    Captured at the scan, these give keep-last deduplication a total order.
    """
    meta = F.col("_metadata")
    extra = {
        FILE: plain_path(meta.getField("file_path")),
        FILE_TIME: meta.getField("file_modification_time"),
        FOLDER_DATE: folder_date(meta.getField("file_path"), meta.getField("file_modification_time")),
    }
    if row_index:
        extra[ROW] = meta.getField("row_index")
    return df.withColumns(extra)


def any_of(patterns: Iterable[str]) -> str:
    """One glob for several, so that a file that fits two of them is read once."""
    patterns = list(patterns)
    return patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"


def scan(spark: SparkSession, folder: str | list[str], schema: T.StructType | None = None,
         patterns: Iterable[str] = ("*.parquet",), dates: tuple[str, str] | None = None,
         skip_normalized: bool = True, skip_corrupt: bool = True) -> DataFrame:
    """Parquet snapshots under a folder (or named files), pruned by globs and an inclusive folder-date range.

    Unreadable files are skipped unless `skip_corrupt` is off; then they fail the query. Folder dates and names are file metadata, so Spark drops
    the files before opening them.
    """
    reader = (
        utc(spark).read.option("recursiveFileLookup", True).option("pathGlobFilter", any_of(patterns))
        .option("ignoreCorruptFiles", skip_corrupt)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)
    df = with_file_columns(reader.parquet(*([folder] if isinstance(folder, str) else folder)))
    if skip_normalized:
        df = df.where(~F.col(FILE).contains("normalized"))
    if dates:
        df = df.where(F.col(FOLDER_DATE).between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    return df


def scan_feed(spark: SparkSession, base: str, feed: str, dates: tuple[str, str] | None = None,
              files: list[str] | None = None, skip_corrupt: bool = True) -> DataFrame:
    """Raw rows of one feed by its landing layout and declared schema (situations keep their own columns)."""
    folder, patterns = RAW_LAYOUT[feed]
    named = [literal(f) for f in files] if files else None
    return scan(spark, named or f"{base.rstrip('/')}/{folder}", RAW.get(feed), patterns, dates, skip_corrupt=skip_corrupt)


def dated_folders(spark: SparkSession, folder: str, dates: tuple[str | None, str | None]) -> list[str]:
    """What to list of a landing folder for an interval of dates: its date folders inside it and all that has no date in its name."""
    first, last = dates

    def wanted(name: str) -> bool:
        return not real_date(name) or ((first is None or name >= first) and (last is None or name <= last))

    return [f"{folder.rstrip('/')}/{literal(n)}" for n in child_names(spark, folder) if wanted(n)]


def real_date(name: str) -> bool:
    """Whether a name is a date in the way that folder dates are told."""
    try:
        return len(name) == 10 and date.fromisoformat(name) is not None
    except ValueError:
        return False


def literal(name: str) -> str:
    """A file or folder name as a glob that only it fits."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def listing(spark: SparkSession, folder: str, pattern: str = "*.parquet", skip_normalized: bool = True,
            dates: tuple[str | None, str | None] | None = None) -> DataFrame:
    """One row per file: key, last_modified and bytes, from the file index alone (no content is read).

    With `dates`, an inclusive interval with open ends, folders of other dates are not listed.
    """
    utc(spark)
    paths = [folder] if dates is None else dated_folders(spark, folder, dates)
    if not paths:
        return spark.createDataFrame([], "key string, last_modified timestamp, bytes long")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(paths)
        .select(F.regexp_replace("path", "^file:/+", "file:/").alias("key"), F.col("modificationTime").alias("last_modified"),
                F.col("length").alias("bytes"))
    )
    return files.where(~F.col("key").contains("normalized")) if skip_normalized else files


def listing_in_order(files: DataFrame) -> DataFrame:
    """Oldest first; equal times by key."""
    return files.orderBy("last_modified", "key")


def file_counts(rows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Rows per file for a scan that carries file columns."""
    return rows.groupBy(*by, FILE, FILE_TIME).agg(F.count(F.lit(1)).alias("n_rows"))


def file_table(rows: DataFrame, source: str) -> DataFrame:
    """The scanned files of a feed as the health report takes them: source, key, last_modified, n_rows."""
    return file_counts(rows).select(
        F.lit(source).alias("source"), F.col(FILE).alias("key"), F.col(FILE_TIME).alias("last_modified"), "n_rows")


def unread_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Listed files that gave no row: unreadable or empty ones, to be counted per run."""
    return files.join(rows.select(F.col(FILE).alias("key")).distinct(), "key", "left_anti")


def latest_file(files: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """The newest file (per group), found by a map-side combinable maximum."""
    newest = F.max_by("key", F.struct("last_modified", "key")).alias("key")
    return files.groupBy(*by).agg(newest, F.max("last_modified").alias("last_modified"))


def rows_of_latest_file(rows: DataFrame) -> DataFrame:
    """Rows of the newest snapshot; its name is a scalar subquery, so nothing is shuffled but one maximum."""
    newest = rows.select(F.max(F.struct(F.col(FILE_TIME), F.col(FILE))).getField(FILE)).scalar()
    return rows.where(F.col(FILE) == newest)


def feed_of(file_name: Column, source: Column | None = None) -> Column:
    """Feed by ordered file-name tests, else the row's own source value."""
    hits = [F.when(file_name.contains(text), F.lit(feed)) for text, feed in FILE_NAME_TESTS]
    return F.coalesce(*hits, source) if source is not None else F.coalesce(*hits)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def read_normalized_files(spark: SparkSession, folder: str, feed: str,
                          dates: tuple[str, str] | None = None) -> DataFrame:
    """Flat or dated folder of `*_normalized_*.parquet` files, one feed of it.

    With a date window only its dated folders are read; when none matches, all files are.
    """
    utc(spark)
    reader = (
        spark.read.option("recursiveFileLookup", True).option("mergeSchema", True)
        .option("ignoreCorruptFiles", True).option("pathGlobFilter", "*_normalized_*.parquet")
    )
    df = with_file_columns(reader.parquet(folder))
    own = F.col("source") if "source" in df.columns else None
    df = df.where(feed_of(base_name(F.col(FILE)), own) == feed)
    if dates:
        inside = df.where(
            folder_date(F.col(FILE)).between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date"))
        )
        return df if inside.isEmpty() else inside
    return df


def read_normalized_table(spark: SparkSession, base: str, feed: str,
                          dates: tuple[str, str] | None = None) -> DataFrame:
    """A feed's normalized table as its newest version has it: only folders of the window are read, else all are.

    A feed that was never written is empty; a table without versions, as older releases wrote it, is read whole.
    """
    path = f"{base.rstrip('/')}/{feed}"
    schema = table_schema(feed)
    if not path_exists(utc(spark), path):
        return spark.createDataFrame([], schema)
    if not versions(spark, path):
        df = spark.read.schema(schema).parquet(path)
        if dates:
            inside = df.where(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
            return df if inside.isEmpty() else inside
        return df
    now = parts(spark, path)
    if dates:
        inside = now.where(F.col("date").between(F.lit(dates[0]), F.lit(dates[1])))
        now = now if inside.isEmpty() else inside
    return read_parts(spark, path, schema, now)


def table_schema(feed: str) -> T.StructType:
    """Columns of a feed's normalized table, with the two of its folders."""
    return T.StructType([f for f in NORMALIZED[feed].fields if f.name != "date"]).add("date", "date").add("run", "string")


def stop_rows(trips: DataFrame, operator: str | None = None) -> DataFrame:
    """One row per stop update, stamped with the minute its snapshot was written."""
    if operator:
        trips = trips.where(base_name(F.col(FILE)).startswith(f"{operator}_siri_et_"))
    update = trips.select(
        F.explode_outer("stop_time_updates").alias("u"),
        bucket(F.col(FILE_TIME)).alias("minute"),
        F.col(FOLDER_DATE).alias("folder_date"),
        F.regexp_extract(base_name(F.col(FILE)), r"^([A-Z]+)_", 1).alias("operator"),
    )
    return update.select("operator", "folder_date", "minute", "u.stop_id", "u.arrival_delay", "u.departure_delay")


def dates_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All dates of an inclusive window."""
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(span).alias("date"))


def profile(df: DataFrame, feed: str) -> DataFrame:
    """Row count, time and temperature span of a normalized table, and the required columns it lacks."""
    def when_present(name: str, build) -> Column:
        return build(F.col(name)) if name in df.columns else F.lit(None)

    missing = [c for c in REQUIRED_COLUMNS.get(feed, ()) if c not in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        when_present("timestamp", lambda c: F.min(c).cast("string")).alias("first_time"),
        when_present("timestamp", lambda c: F.max(c).cast("string")).alias("last_time"),
        when_present("road_temperature", F.min).cast("double").alias("min_temperature"),
        when_present("road_temperature", F.max).cast("double").alias("max_temperature"),
        when_present("road_temperature", F.count).cast("bigint").alias("n_temperature"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(missing)).alias("missing_columns"),
    )
