"""Which parts of a table count: a log of versions.

A run writes its rows under <table>/date=/run=, where nobody looks yet. Then a version is added to <table>/_versions:
one small Parquet file with a row for each part that counts, put in place by one rename. Readers take the
newest version and open its folders only, so they see a run whole or not at all, and a replaced run until its
replacement counts. `run` is the run that brought the rows, `place` the folder that holds them now, which compaction
changes. Tables of streams use the same log with query= and batch= as their two levels of folders. Parts that no longer count stay until `sweep` removes them, so a reader that began before keeps its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.session import child_names, materialise, path_bytes, path_exists, remove, rename
from urbanpulse.sources.schemas import each, struct

VERSIONS = "_versions"
LEVELS = ("date", "run")  # names of the two levels of folders
PARTS = struct(each("date run place"))
TARGET_BYTES = 128 << 20
ATTEMPTS = 20


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of all versions, oldest first."""
    return sorted(int(n.partition(".")[0]) for n in child_names(spark, f"{table}/{VERSIONS}") if n[0].isdigit())


def _file(table: str, version: int) -> str:
    return f"{table}/{VERSIONS}/{version:020d}.parquet"


def parts(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """date, run and place of every part of a version (the newest); without any version no part counts."""
    known = versions(spark, table)
    if not known:
        return spark.createDataFrame([], PARTS)
    return spark.read.schema(PARTS).parquet(_file(table, known[-1] if version is None else version))


def begin(spark: SparkSession, table: str, levels: tuple[str, str] = LEVELS) -> None:
    """Give a table its first version; what older releases wrote there without versions counts."""
    if not versions(spark, table):
        found = [(d, r, r) for d, r in written_parts(spark, table, levels)]
        _put(spark, table, 0, spark.createDataFrame(found, PARTS))


def written_parts(spark: SparkSession, table: str, levels: tuple[str, str] = LEVELS) -> list[tuple[str, str]]:
    """Values of the two levels of all folders of a table, whether they count or not."""
    outer, inner = (f"{x}=" for x in levels)
    return [(d.removeprefix(outer), r.removeprefix(inner)) for d in child_names(spark, table) if d.startswith(outer)
            for r in child_names(spark, f"{table}/{d}") if r.startswith(inner)]


def _put(spark: SparkSession, table: str, version: int, rows: DataFrame) -> bool:
    """Write a version beside the others and rename it into place; False if another writer was first."""
    draft = f"{table}/{VERSIONS}/_draft-{uuid.uuid4().hex}"
    rows.select(*PARTS.names).coalesce(1).write.parquet(draft)
    written = [n for n in child_names(spark, draft) if n.startswith("part-")]
    done = rename(spark, f"{draft}/{written[0]}", _file(table, version))
    remove(spark, draft)
    return done


def change(spark: SparkSession, table: str, step: Callable[[DataFrame], DataFrame | None], keep: int | None = None) -> bool:
    """Add the version that `step` makes of the newest one; tried again on a newer one if another writer was first.

    `step` gives None if nothing is to change. With `keep`, versions older than so many are removed (their parts are not).
    """
    for _ in range(ATTEMPTS):
        known = versions(spark, table)
        rows = step(parts(spark, table, known[-1]))
        if rows is None:
            return False
        if _put(spark, table, known[-1] + 1, rows):
            for v in known[:1 - keep] if keep else ():
                remove(spark, _file(table, v))
            return True
    raise RuntimeError(f"{table}: other writers were first {ATTEMPTS} times")


def holds(spark: SparkSession, table: str, run: str) -> bool:
    """Whether a run's rows count already."""
    return not parts(spark, table).where(F.col("run") == run).isEmpty()


def add_run(spark: SparkSession, table: str, run: str, dates: Iterable[str], replaced: Iterable[str] = ()) -> bool:
    """Let a run's dates count; of `replaced` dates all other runs no longer do."""
    new, old = spark.createDataFrame([(d, run, run) for d in dates], PARTS), list(replaced)
    return change(spark, table, lambda now: (now.where(~F.col("date").isin(old)) if old else now).where(F.col("run") != run).union(new))


def folders(table: str, rows: DataFrame, levels: tuple[str, str] = LEVELS) -> list[str]:
    """The folders that hold parts; as many as there are dates and runs not yet compacted."""
    return [f"{table}/{levels[0]}={r['date']}/{levels[1]}={r['place']}" for r in rows.select("date", "place").distinct().toLocalIterator()]


def written_dates(spark: SparkSession, table: str, run: str, dates: Iterable[str]) -> list[str]:
    return [d for d in dates if path_exists(spark, f"{table}/date={d}/run={run}")]


def clear(spark: SparkSession, table: str, run: str, dates: Iterable[str]) -> None:
    """Remove what an attempt of a run left behind that never came to count."""
    for d in dates:
        remove(spark, f"{table}/date={d}/run={run}")


def read_parts(spark: SparkSession, table: str, schema: T.StructType, rows: DataFrame) -> DataFrame:
    """Rows of the given parts, with `date` and `run` (the place) from the folders."""
    found = folders(table, rows)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*found)


def compact(spark: SparkSession, table: str, schema: T.StructType, target: int = TARGET_BYTES, dates: Sequence[str] | None = None) -> list[str]:
    """Pack the files of each date into files of about `target` bytes; returns the dates whose rows moved.

    Dates that hold no more files than they need are left alone. Rows are dealt to files by hash, so a large date is many tasks.
    A run added meanwhile keeps its own folder; a date that was replaced meanwhile stays as it then is.
    """
    now = materialise(parts(spark, table) if dates is None else parts(spark, table).where(F.col("date").isin(list(dates))))
    needed: list[tuple[str, int]] = []
    held: dict[str, list[str]] = {}
    for r in now.select("date", "place").distinct().toLocalIterator():
        held.setdefault(r["date"], []).append(f"{table}/date={r['date']}/run={r['place']}")
    for date, own in sorted(held.items()):
        files = -(-sum(path_bytes(spark, p) for p in own) // target)
        if sum(len([n for n in child_names(spark, p) if n.startswith("part-")]) for p in own) > files:
            needed.append((date, files))
    if not needed:
        return []
    place = f"compact-{uuid.uuid4().hex}"
    plan = F.broadcast(spark.createDataFrame(needed, "_date string, _files long"))  # a row for each date
    moved = now.join(plan.select(F.col("_date").alias("date")), "date")
    rows = read_parts(spark, table, schema, moved).join(plan, F.col("date").cast("string") == F.col("_date"))
    names = [f.name for f in schema if f.name not in ("date", "run")]
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64(*names), "_files"))
    dealt = dealt.repartition(sum(n for _, n in needed), "date", "_file").select(*names, "date", F.lit(place).alias("run"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "run").parquet(table)
    before = {(r["date"], r["run"], r["place"]) for r in moved.toLocalIterator()}
    done: list[str] = []

    def step(newest: DataFrame) -> DataFrame | None:
        there = {(r["date"], r["run"], r["place"]) for r in newest.join(plan.select(F.col("_date").alias("date")), "date").toLocalIterator()}
        done[:] = sorted({d for d, _ in needed} - {d for d, *_ in before - there})
        if not done:
            return None
        old = spark.createDataFrame([p for p in before if p[0] in set(done)], PARTS).withColumn("_moved", F.lit(True))
        return newest.join(F.broadcast(old), PARTS.names, "left").select(
            "date", "run", F.when(F.col("_moved"), F.lit(place)).otherwise(F.col("place")).alias("place"))

    change(spark, table, step)
    return done


def sweep(spark: SparkSession, table: str, open_runs: Iterable[str] = (), keep: int = 1, levels: tuple[str, str] = LEVELS) -> int:
    """Remove parts that none of the last `keep` versions has and no open run is writing, and older versions; returns how many parts.

    Readers of removed versions lose their files, so `keep` should cover the longest query.
    """
    known = versions(spark, table)
    counted = {(r["date"], r["place"]) for v in known[-keep:] for r in parts(spark, table, v).toLocalIterator()}
    busy, gone = set(open_runs), 0
    for date, run in written_parts(spark, table, levels):
        if run not in busy and (date, run) not in counted:
            remove(spark, f"{table}/{levels[0]}={date}/{levels[1]}={run}")
            gone += 1
    for v in known[:-keep]:
        remove(spark, _file(table, v))
    return gone
