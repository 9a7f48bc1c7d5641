"""Structured Streaming over the landing folders.

Every sink writes a micro-batch into a folder of its own, named by the streaming query (which lives as long as its checkpoint) and the
batch; it counts once the table's log names it, so readers see whole batches. A retried batch overwrites itself. A renewed
checkpoint is a new query: what it writes takes the place of the old query's at once when its first run ends, so nothing is
lost or doubled. Batches are merged in tiers, eight of a tier into one of the next: a row is written again a few times, however old
the stream is, and readers open a few folders.

Aggregates are written in update mode: each batch holds the new value of the keys it touched, and `latest` reads the
last one. Rows later than the watermark can be kept aside and added afterwards.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanpulse.fixed import OUTAGE_FACTOR
from urbanpulse.operators.dedup import keep_last
from urbanpulse.operators.health import consecutive, distinct_instants
from urbanpulse.session import child_names, path_exists, read_bytes, remove, utc
from urbanpulse.sources import commits

QUERY, BATCH = LEVELS = ("query", "batch")
SEQ = "_batch"  # number of the batch a row came with
FANOUT = 8  # parts of a tier that are merged into one
VERSIONS_KEPT = 50  # of a stream's log; a reader that began before them may lose its files

Each = Callable[[DataFrame, int, str], DataFrame]
Merge = Callable[[DataFrame], DataFrame]


def stream_snapshots(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                     files_per_batch: int = 1000) -> DataFrame:
    """New snapshot files as a stream; the checkpoint of the query is the ledger of processed files."""
    return (
        utc(spark).readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The streaming query a checkpoint belongs to."""
    return json.loads(read_bytes(spark, f"{checkpoint}/metadata"))["id"]


def part_of(path: str, query: str, place: str | int) -> str:
    return f"{path}/{QUERY}={query}/{BATCH}={place}"


def write_batch(df: DataFrame, query: str, batch: int, path: str) -> None:
    df.withColumn(SEQ, F.lit(batch).cast("long")).write.mode("overwrite").parquet(part_of(path, query, batch))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Each | None = None,
                  merge: Merge | None = None) -> None:
    """Process everything that has arrived, then stop.

    `merge` says how several batches become one part: the rows that still matter (all, if it is not given).
    """
    spark = stream.sparkSession
    commits.begin(spark, path, LEVELS)
    known = {r["date"] for r in commits.parts(spark, path).select("date").distinct().toLocalIterator()}

    def handle(df: DataFrame, batch: int) -> None:
        query = query_id(spark, checkpoint)
        write_batch(each(df, batch, query) if each else df, query, batch, path)
        if not known or query in known:
            add_batches(spark, path, query)
            merge_tiers(spark, path, query, merge)

    running = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(handle).start()
    )
    running.awaitTermination()
    if path_exists(spark, f"{checkpoint}/metadata"):
        add_batches(spark, path, query_id(spark, checkpoint))
    if merged_away(spark, path) > FANOUT * FANOUT:
        forget(spark, path)


def merged_away(spark: SparkSession, path: str) -> int:
    """Folders of a stream's table that no longer count."""
    return len(commits.written_parts(spark, path, LEVELS)) - commits.parts(spark, path).count()


def number(run: str) -> int:
    """Number of the last batch of a part."""
    return int(run)


def add_batches(spark: SparkSession, path: str, query: str) -> None:
    """Let all written batches of a query count, and no other query's."""
    written = [int(n.removeprefix(f"{BATCH}=")) for n in child_names(spark, f"{path}/{QUERY}={query}")
               if n.removeprefix(f"{BATCH}=").isdigit()]

    def step(now: DataFrame) -> DataFrame | None:
        rows = [tuple(r) for r in now.toLocalIterator()]
        own = [r for r in rows if r[0] in (query, late_name(query))]
        last = max((number(r[1]) for r in own if r[0] == query), default=-1)
        new = [(query, f"{b:020d}", str(b)) for b in sorted(written) if b > last]
        return spark.createDataFrame(own + new, commits.PARTS) if new or len(own) < len(rows) else None

    commits.change(spark, path, step, keep=VERSIONS_KEPT)


def late_name(query: str) -> str:
    """Where late rows of a query stand in its table."""
    return f"late-{query}"


def tier(place: str) -> int:
    """0 for a batch, one more for each time it was merged."""
    return int(place[1:place.index("-")]) if place.startswith("t") else 0


def merge_tiers(spark: SparkSession, path: str, query: str, merge: Merge | None = None) -> None:
    """Merge the parts of a tier into one of the next as soon as there are FANOUT of them."""
    level = 0
    while True:
        now = sorted((r["run"], r["place"]) for r in commits.parts(spark, path).where(F.col("date") == query).toLocalIterator())
        own = [(run, place) for run, place in now if tier(place) == level]
        if not any(tier(place) >= level for _, place in now):
            return
        if len(own) >= FANOUT:
            place = f"t{level + 1}-{uuid.uuid4().hex}"
            rows = spark.read.parquet(*[part_of(path, query, p) for _, p in own])
            (merge(rows) if merge else rows).write.parquet(part_of(path, query, place))
            gone, new = [p for _, p in own], spark.createDataFrame([(query, own[-1][0], place)], commits.PARTS)
            commits.change(spark, path, lambda parts: parts.where(~F.col("place").isin(gone)).union(new), keep=VERSIONS_KEPT)
        level += 1


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the batches that count, with the number of their batch."""
    found = commits.folders(path, commits.parts(spark, path), LEVELS)
    return spark.read.option("basePath", path).parquet(*found).drop(QUERY, BATCH) if found else spark.read.parquet(path)


def forget(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Remove parts that the last `keep` versions do not hold."""
    return commits.sweep(spark, path, (), keep, LEVELS)


def newest(keys: Sequence[str], order: Sequence[str | Column] = (SEQ,)) -> Merge:
    """For `run_available`: of several batches only the last row of a key matters."""
    return lambda df: keep_last(df, keys, order)


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current value of each key of an update-mode sink."""
    return keep_last(read_batches(spark, path), keys, [SEQ]).drop(SEQ)


def windowed(stream: DataFrame, time: Column, measures: Sequence[Column], keys: Sequence[str] = (),
             length: str = "1 minute", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Tumbling or sliding event-time aggregates; rows later than `lateness` are left to the batch run."""
    timed = stream.withColumn("_time", time.cast("timestamp")).withWatermark("_time", lateness)
    return timed.groupBy(F.window("_time", length, slide), *keys).agg(*measures).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys,
        *[F.col(c) for c in _names(timed, measures)])


def _names(df: DataFrame, measures: Sequence[Column]) -> list[str]:
    return df.sparkSession.createDataFrame([], df.schema).agg(*measures).columns


def minute_counts(stream: DataFrame, time: Column, keys: Sequence[str] = (), lateness: str = "1 day") -> DataFrame:
    """Rows per minute and key."""
    return windowed(stream, time, [F.count(F.lit(1)).alias("n")], keys, lateness=lateness)


def rolling_density(stream: DataFrame, time: Column, flag: Column, keys: Sequence[str] = (),
                    lateness: str = "2 days") -> DataFrame:
    """Share of flagged rows over the last 24 hours, every hour."""
    measures = [F.avg(flag.cast("double")).alias("density"), F.count(F.lit(1)).alias("n")]
    return windowed(stream, time, measures, keys, "24 hours", "1 hour", lateness)


def first_seen(stream: DataFrame, time: Column, keys: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within the lateness; the first one is kept."""
    timed = stream.withColumn("_time", time.cast("timestamp")).withWatermark("_time", lateness)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_time")


def last_seen_batch(keys: Sequence[str], order: Sequence[str | Column]) -> Each:
    """For `run_available`: each batch keeps its last row per key; `last_seen` then keeps the last of all.

    With `merge=newest(keys, order)` what is read grows with the keys, not with the age of the stream.
    """
    return lambda df, _batch, _query: keep_last(df, keys, order)


def last_seen(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return keep_last(read_batches(spark, path), keys, order).drop(SEQ)


# ---- rows later than the watermark ----------------------------------------------------------------


def on_time(time: str, late: str, lateness: str, then: Each) -> Each:
    """For `run_available`: rows older than the watermark go to the table `late`, the others on to `then`.

    The watermark of a batch is the greatest time of all earlier ones less `lateness` (an interval in words). It is kept beside
    each batch, so a repeated batch splits its rows as before. Rows without a time are on time.
    """
    def split(df: DataFrame, batch: int, query: str) -> DataFrame:
        spark, marks = df.sparkSession, f"{late}-marks"
        before = part_of(marks, query, batch - 1)
        mark = spark.read.parquet(before).first()["at"] if batch and path_exists(spark, before) else None
        at, reached = F.col(time).cast("timestamp"), F.lit(mark).cast("long")
        is_late = F.coalesce(at < F.timestamp_micros(reached) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        commits.begin(spark, late, LEVELS)
        write_batch(df.where(is_late), query, batch, late)
        add_batches(spark, late, query)
        df.agg(F.greatest(F.unix_micros(F.max(at)), reached).alias("at")).write.mode("overwrite").parquet(part_of(marks, query, batch))
        remove(spark, part_of(marks, query, batch - 2))  # a repeated batch reads the one before it, no other
        return then(df.where(~is_late), batch, query)

    return split


def minute_partials(time: str, keys: Sequence[str]) -> Each:
    """For `run_available`: rows per minute and key of a batch alone, which add up."""
    return lambda df, _batch, _query: df.groupBy(F.date_trunc("minute", time).alias("minute"), *keys).agg(F.count(F.lit(1)).alias("n"))


def summed(keys: Sequence[str]) -> Merge:
    """For `run_available`: batches whose counts `n` add up."""
    return lambda df: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(SEQ).alias(SEQ))


def add_late_rows(spark: SparkSession, path: str, late: str, then: Each) -> int:
    """Add the rows kept aside to a table whose batches add up; returns how many there were.

    The part that is added is named by the last batch whose late rows it holds, and a version of the table says so, so a repeated
    call adds nothing twice.
    """
    kept = commits.parts(spark, late)
    done = {r["date"]: number(r["run"]) for r in commits.parts(spark, path).toLocalIterator()}
    total = 0
    for query in [r["date"] for r in kept.select("date").distinct().toLocalIterator()]:
        own = [(r["run"], r["place"]) for r in kept.where(F.col("date") == query).toLocalIterator() if number(r["run"]) > done.get(late_name(query), -1)]
        if not own:
            continue
        last, rows = max(own)[0], spark.read.parquet(*[part_of(late, query, p) for _, p in own])
        name, total = late_name(query), total + rows.count()
        add = then(rows.drop(SEQ), number(last), query).withColumn(SEQ, F.lit(number(last)).cast("long"))
        if (old := [p for p in commits.folders(path, commits.parts(spark, path).where(F.col("date") == name), LEVELS)]):
            add = add.unionByName(spark.read.parquet(*old))
        place = uuid.uuid4().hex
        add.write.parquet(part_of(path, name, place))
        new = spark.createDataFrame([(name, last, place)], commits.PARTS)
        commits.change(spark, path, lambda now, name=name, new=new: now.where(F.col("date") != name).union(new))
    return total


# ---- gaps between arrivals -------------------------------------------------------------------------


def spans(instants: DataFrame, keys: Sequence[str], longest: Column) -> DataFrame:
    """(keys, start, end): stretches of a source's instants `at` without a gap of more than `longest` seconds."""
    keys = list(keys)
    gaps = consecutive(instants, keys, "at").where(F.col("gap_s") > longest)
    ends = instants.groupBy(*keys).agg(F.min("at").alias("start"), F.max("at").alias("_last"))
    none = F.lit(None).cast("timestamp")
    begins = ends.select(*keys, "start", none.alias("_before"), "_last").unionByName(
        gaps.select(*keys, F.col("until").alias("start"), F.col("since").alias("_before"), none.alias("_last")))
    of_source = W.partitionBy(*keys)
    return begins.select(*keys, "start", F.coalesce(
        F.lead("_before").over(of_source.orderBy("start")), F.max("_last").over(of_source)).alias("end"))


def joined_spans(parts: DataFrame, keys: Sequence[str], longest: Column) -> DataFrame:
    """Stretches that overlap or lie at most `longest` seconds apart become one; a source has as many as it has outages."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.unix_micros("start") - F.unix_micros(reached)) / F.lit(1e6) > longest
    numbered = parts.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy(*keys, "_span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_span")


def outages(parts: DataFrame, keys: Sequence[str], longest: Column, clock: int | None) -> DataFrame:
    """(keys, since, until) between neighbouring stretches; `until` is null for a source that is silent as of the clock (microseconds)."""
    order = W.partitionBy(*keys).orderBy("start")
    between = parts.select(*keys, F.lag("end").over(order).alias("since"), F.col("start").alias("until")).where("since IS NOT NULL")
    last = parts.groupBy(*keys).agg(F.max("end").alias("since"))
    silent = last.where((F.lit(clock).cast("long") - F.unix_micros("since")) / F.lit(1e6) > longest)
    return between.unionByName(silent.withColumn("until", F.lit(None).cast("timestamp")))


def gap_alarms(keys: Sequence[str], time: str, nominal: Column, state: str, factor: int = OUTAGE_FACTOR,
               lateness: str = "1 day") -> Each:
    """For `run_available`: gaps longer than a multiple of the nominal interval, raised and withdrawn.

    The state of a source is its stretches without such a gap, within `lateness` of the stream's clock (the greatest time seen),
    which is all that a late row can change: it joins or splits none, or closes part of a gap. A batch's own
    stretches are merged with those of the batch before, whose folder is the only one that is read. Rows: (keys, since, until, gap_s,
    raised); an alarm whose gap was shortened or closed comes again with raised = false. A source that is silent raises an
    alarm without an end as soon as the clock has passed it by that much, which other sources' rows move on.
    """
    keys, longest = list(keys), factor * nominal

    def alarms(df: DataFrame, batch: int, query: str) -> DataFrame:
        spark, before = df.sparkSession, part_of(state, query, batch - 1)
        own = spans(distinct_instants(df, keys, time).select(*keys, "at"), keys, longest)
        old = spark.read.parquet(before).drop(SEQ) if batch and path_exists(spark, before) else spark.createDataFrame([], own.schema)
        then = old.agg(F.unix_micros(F.max("end"))).first()[0]
        write_batch(joined_spans(old.unionByName(own), keys, longest), query, batch, f"{state}-whole")
        whole = spark.read.parquet(part_of(f"{state}-whole", query, batch)).drop(SEQ)
        now = whole.agg(F.unix_micros(F.max("end"))).first()[0]
        horizon = F.timestamp_micros(F.lit(now).cast("long")) - F.expr(f"INTERVAL {lateness}")
        next_start = F.lead("start").over(W.partitionBy(*keys).orderBy("start"))
        write_batch(whole.withColumn("_next", next_start).where(F.col("_next").isNull() | (F.col("_next") >= horizon)).drop("_next"),
                    query, batch, state)
        for old_part in (part_of(state, query, batch - 2), part_of(f"{state}-whole", query, batch - 1)):
            remove(spark, old_part)
        was, is_ = outages(old, keys, longest, then), outages(whole, keys, longest, now)
        both = was.withColumn("raised", F.lit(False)).unionByName(is_.withColumn("raised", F.lit(True)))
        changed = both.groupBy(*keys, "since", "until").agg(F.count(F.lit(1)).alias("_n"), F.max("raised").alias("raised")).where("_n = 1")
        return changed.select(*keys, "since", "until", ((F.unix_micros("until") - F.unix_micros("since")) / F.lit(1e6)).alias("gap_s"), "raised")

    return alarms


def standing_alarms(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The alarms that were raised and not withdrawn: (keys, since, until, gap_s)."""
    return keep_last(read_batches(spark, path), [*keys, "since", "until"], [SEQ]).where("raised").drop(SEQ, "raised")
