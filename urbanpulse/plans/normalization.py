"""From raw snapshots to the normalized table, incrementally."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanpulse.fixed import RAW_LAYOUT
from urbanpulse.functions.times import folder_date
from urbanpulse.operators.dedup import dedup_clock, latest_flights, latest_trips
from urbanpulse.operators.normalize import (
    NORMALIZERS,
    OWN_DATE_COLUMN,
    normalize_bikes,
    own_date_only,
    station_capacity,
)
from urbanpulse.operators.unify import project
from urbanpulse.session import materialise, path_exists
from urbanpulse.sources import commits
from urbanpulse.sources.schemas import NORMALIZED
from urbanpulse.sources.sinks import (
    end_run,
    in_interval,
    mark_processed,
    not_processed,
    open_runs,
    plan_runs,
    read_ledger,
    read_outcome,
    read_plan,
    record_unread,
    with_file_date,
    write_normalized,
    write_outcome,
)
from urbanpulse.sources.snapshots import FILE, FOLDER_DATE, any_of, latest_file, listing, scan_feed, table_schema

FEEDS = ("flights", "bikes", "road_weather", "travel_times", "situations", "trips")
# Files of a run, unless one date has more: their names pass through the driver.
RUN_FILES = 50_000


def new_files(spark: SparkSession, raw: str, feed: str, ledger: str, start: str | None, end: str | None,
              rerun_all: bool, all_dates: bool) -> DataFrame:
    """Files of a feed inside the interval that the ledger does not hold; date folders outside it are not listed."""
    folder, patterns = RAW_LAYOUT[feed]
    if start is None and end is None and not all_dates:
        start = end = str(spark.range(1).select(F.current_date()).first()[0])
    span = None if all_dates else (start, end)
    dated = with_file_date(listing(spark, f"{raw.rstrip('/')}/{folder}", any_of(patterns), dates=span))
    if not all_dates:
        dated = dated.where(in_interval(F.col("date"), start, end))
    return not_processed(dated, read_ledger(spark, ledger, feed), rerun_all)


def normalized(spark: SparkSession, raw: str, feed: str, rows: DataFrame) -> DataFrame:
    """Deduplicated normalized rows of one feed, with the folder date as `date`."""
    if feed == "flights":
        out = NORMALIZERS[feed](latest_flights(rows))
    elif feed == "bikes":
        folder, patterns = RAW_LAYOUT["bike_stations"]
        newest = latest_file(listing(spark, f"{raw.rstrip('/')}/{folder}", any_of(patterns))).first()
        info = scan_feed(spark, raw, "bike_stations", files=[newest["key"]]) if newest and newest["key"] else None
        out = normalize_bikes(rows, None if info is None else station_capacity(info))
    elif feed == "trips":
        out = NORMALIZERS[feed](rows)
        out = latest_trips(out, dedup_clock(out))
    else:
        out = NORMALIZERS[feed](rows)
    if feed in OWN_DATE_COLUMN and FOLDER_DATE in out.columns:
        out = own_date_only(out, OWN_DATE_COLUMN[feed])
    declared = project(out.withColumnRenamed("date", "_own_date") if "date" in out.columns else out,
                       type(NORMALIZED[feed])([f for f in NORMALIZED[feed].fields if f.name != "date"])
                       .add("_folder_date", "date"))
    return declared.withColumnRenamed("_folder_date", "date")


class Files(NamedTuple):
    """Files of a feed that a run read, and those that gave no rows."""

    read: int
    unread: int


def normalize_feed(spark: SparkSession, raw: str, out: str, ledger: str, feed: str, start: str | None = None,
                   end: str | None = None, rerun_all: bool = False, all_dates: bool = False) -> Files:
    """Process the new files of a feed.

    A run's file list is written down before its data. Its rows count once a version of the table names
    them, so a reader sees a run whole or not at all. Runs that did not end are repeated first: those whose rows
    count are only entered in the ledger, the others begin anew. So neither a crash nor files that arrive after it double or
    lose rows. With `rerun_all` a run replaces the dates of which it could read all files again.
    """
    commits.begin(spark, table_of(out, feed))
    done = [process(spark, raw, out, ledger, feed, run) for run in open_runs(spark, ledger, feed)]
    files = materialise(new_files(spark, raw, feed, ledger, start, end, rerun_all, all_dates))
    mark = f"v{commits.versions(spark, table_of(out, feed))[-1]}"
    for run in plan_runs(files, ledger, feed, rerun_all, mark, RUN_FILES):
        done.append(process(spark, raw, out, ledger, feed, run))
    return Files(sum(d.read for d in done), sum(d.unread for d in done))


def table_of(out: str, feed: str) -> str:
    return f"{out.rstrip('/')}/{feed}"


def process(spark: SparkSession, raw: str, out: str, ledger: str, feed: str, run: str) -> Files:
    """Carry out a planned run.

    A look at the footers of its files tells which can be opened; these are read strictly. If that fails, the files that
    break are found, set aside with the reason, and the others are read; an error that no file
    brings about fails the run, which is repeated next time.
    """
    table, plan = table_of(out, feed), materialise(read_plan(spark, ledger, feed, run))
    first, told = plan.first(), commits.holds(spark, table, run)
    if told and (outcome := read_outcome(spark, ledger, feed, run)) is not None:  # it only lacks its ledger entry
        return settle(outcome, ledger, feed, run)
    keys = [r["key"] for r in plan.select("key").toLocalIterator()]
    sound = scan_feed(spark, raw, feed, files=keys).groupBy(FILE).agg(F.count(F.lit(1)).alias("n_rows"))
    seen = plan.join(sound.withColumnRenamed(FILE, "key"), "key", "left")
    reason = F.when(F.col("n_rows").isNull(), "unreadable or without rows")
    state = materialise(seen.withColumn("reason", reason))
    if told:  # another ledger entered it
        return settle(state, ledger, feed, run)
    commits.clear(spark, table, run, [r["date"] for r in plan.select("date").distinct().toLocalIterator()])
    names = [r["key"] for r in state.where("reason IS NULL").select("key").toLocalIterator()]
    if names:
        try:
            write_rows(spark, raw, out, feed, run, names)
        except Exception:
            broken = broken_files(spark, raw, feed, names)
            if not broken:
                raise
            bad = spark.createDataFrame(sorted(broken.items()), "key string, why string")
            state = materialise(state.join(bad, "key", "left").withColumn("reason", F.coalesce("reason", "why")).drop("why"))
            names = [r["key"] for r in state.where("reason IS NULL").select("key").toLocalIterator()]
            commits.clear(spark, table, run, [r["date"] for r in plan.select("date").distinct().toLocalIterator()])
            if names:
                write_rows(spark, raw, out, feed, run, names)
    good, unread = state.where("reason IS NULL"), state.where("reason IS NOT NULL")
    if first["replaces"]:
        lost = read_ledger(spark, ledger, feed).join(good, "key", "left_anti")
        kept = lost.select(F.coalesce("date", folder_date(F.col("key")).cast("string")).alias("date")).distinct()
        unread = unread.unionByName(good.join(kept, "date", "left_semi").withColumn(
            "reason", F.lit("its date was not replaced, as not all of the date's files could be read")))
        good = good.join(kept, "date", "left_anti")
    write_outcome(good.unionByName(unread), ledger, feed, run)
    outcome = read_outcome(spark, ledger, feed, run)
    dates = [r["date"] for r in outcome.where("reason IS NULL").select("date").distinct().toLocalIterator()]
    if dates:
        commits.add_run(spark, table, run, commits.written_dates(spark, table, run, dates), dates if first["replaces"] else ())
    return settle(outcome, ledger, feed, run)


def settle(outcome: DataFrame, ledger: str, feed: str, run: str) -> Files:
    """Enter what became of a run's files, once its rows count, and end the run."""
    unread = outcome.where("reason IS NOT NULL")
    read, lost = outcome.where("reason IS NULL").count(), unread.count()
    if read:
        mark_processed(outcome.where("reason IS NULL"), ledger, feed)
    if lost:
        record_unread(unread, ledger, feed, run)
    end_run(outcome.sparkSession, ledger, feed, run)
    return Files(read, lost)


def write_rows(spark: SparkSession, raw: str, out: str, feed: str, run: str, names: list[str]) -> None:
    rows = scan_feed(spark, raw, feed, files=names, skip_corrupt=False)
    write_normalized(normalized(spark, raw, feed, rows), out, run, feed)


def broken_files(spark: SparkSession, raw: str, feed: str, names: list[str]) -> dict[str, str]:
    """The files that cannot be read to their end, with the reason.

    One pass reads every page and skips the rest of a file that breaks: files with fewer rows than their footers
    tell are broken. Errors that Spark does not skip are cornered by halving the files that fail.
    """
    try:
        whole = scan_feed(spark, raw, feed, files=names).groupBy(FILE).agg(F.count(F.lit(1)).alias("n"))
        rows = scan_feed(spark, raw, feed, files=names)
        pages = rows.groupBy(FILE).agg(F.count(F.lit(1)).alias("read"), F.bit_xor(F.xxhash64(*rows.columns)).alias("all_columns"))
        short = whole.join(pages, FILE, "left").where("n > coalesce(read, 0) OR (read > 0 AND all_columns IS NULL)")
        return {r[FILE]: f"{r['read'] or 0} of {r['n']} rows could be read" for r in short.toLocalIterator()}
    except Exception as error:
        if len(names) == 1:
            return {names[0]: f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"}
        middle = len(names) // 2
        return broken_files(spark, raw, feed, names[:middle]) | broken_files(spark, raw, feed, names[middle:])


def compact_feed(spark: SparkSession, out: str, feed: str, target: int = commits.TARGET_BYTES, dates: list[str] | None = None) -> list[str]:
    """Pack the small files of a feed's table; returns the dates whose files changed."""
    if not path_exists(spark, table_of(out, feed)):
        return []
    commits.begin(spark, table_of(out, feed))
    return commits.compact(spark, table_of(out, feed), table_schema(feed), target, dates)


def sweep_feed(spark: SparkSession, out: str, ledger: str, feed: str, keep: int = 10) -> int:
    """Remove what the last versions of a feed's table do not hold."""
    return commits.sweep(spark, table_of(out, feed), open_runs(spark, ledger, feed), keep)


def normalize_all(spark: SparkSession, raw: str, out: str, ledger: str, start: str | None = None,
                  end: str | None = None, rerun_all: bool = False, all_dates: bool = False,
                  only_trips: bool = False) -> dict[str, Files]:
    feeds = ("trips",) if only_trips else FEEDS
    return {f: normalize_feed(spark, raw, out, ledger, f, start, end, rerun_all, all_dates) for f in feeds}
