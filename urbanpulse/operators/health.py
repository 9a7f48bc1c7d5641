"""Feed health from file listings and event times: gaps, throughput, latency.

Gaps need the previous arrival. Arrivals are first combined to distinct instants, the
previous one is looked up inside short time slots, and the gaps between slots come from
the slots' ends. No source is ever sorted as one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanpulse.fixed import (
    CYCLES,
    MAX_LATENCY_SECONDS,
    MIN_CYCLE_FILES,
    NOMINAL_INTERVAL_SECONDS,
    ON_TIME_FACTOR,
    OUTAGE_FACTOR,
)
from urbanpulse.functions.rounding import rounded
from urbanpulse.operators.quantiles import exact_quantiles, order_statistics
from urbanpulse.session import beside, materialise


def consecutive(instants: DataFrame, keys: Sequence[str] = ("source",), time: str = "at",
                slot: str = "minute") -> DataFrame:
    """Neighbouring distinct instants of a source: (keys, since, until, gap_s).

    Inside a slot the earlier one is a short window; between slots it is the end of the
    previous slot that has any, from one row per slot.
    """
    keys = list(keys)
    slotted = instants.withColumn("_slot", F.date_trunc(slot, time))
    inner = W.partitionBy(*keys, "_slot").orderBy(time)
    within = slotted.select(*keys, F.lag(time).over(inner).alias("since"), F.col(time).alias("until"))
    slots = slotted.groupBy(*keys, "_slot").agg(F.min(time).alias("until"), F.max(time).alias("_last"))
    across = slots.select(
        *keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_slot")).alias("since"), "until")
    both = within.unionByName(across).where(F.col("since").isNotNull())
    return both.withColumn("gap_s", (F.unix_micros("until") - F.unix_micros("since")) / F.lit(1e6))


def distinct_instants(arrivals: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, at, n): how many arrivals share an instant."""
    at = F.col(time).cast("timestamp")
    return arrivals.where(at.isNotNull()).groupBy(*keys, at.alias("at")).agg(F.count(F.lit(1)).alias("n"))


def arrival_gaps(arrivals: DataFrame, keys: Sequence[str] = ("source",), time: str = "last_modified",
                 slot: str = "minute") -> DataFrame:
    """Gap lengths in seconds with how often each occurs: (keys, gap_s, n).

    The instants feed three branches, so they are written once.
    """
    keys = list(keys)
    instants = materialise(distinct_instants(arrivals, keys, time))
    positive = consecutive(instants, keys, "at", slot).select(*keys, "gap_s", F.lit(1).cast("bigint").alias("n"))
    # arrivals at the same instant are gaps of zero
    zero = instants.where(F.col("n") > 1).select(*keys, F.lit(0.0).alias("gap_s"), (F.col("n") - 1).alias("n"))
    return positive.unionByName(zero).groupBy(*keys, "gap_s").agg(F.sum("n").alias("n"))


def nominal_interval(source: Column) -> Column:
    """Expected seconds between snapshots of a feed."""
    known = F.create_map(*[F.lit(x) for pair in NOMINAL_INTERVAL_SECONDS.items() for x in pair])
    return known[source]


def gap_stats(arrivals: DataFrame, nominal: Column, keys: Sequence[str] = ("source",), time: str = "last_modified") -> DataFrame:
    """Inter-arrival statistics per source; `nominal` is the expected interval in seconds (an expression of the keys)."""
    keys = list(keys)
    gaps = materialise(arrival_gaps(arrivals, keys, time))
    quantiles = exact_quantiles(gaps, keys, "gap_s", {"median_gap_s": 0.5, "p95_gap_s": 0.95}, "n")
    w, g = F.col("n"), F.col("gap_s")
    plain = gaps.groupBy(*keys).agg(
        F.sum(w).alias("n_gaps"),
        rounded(F.sum(g * w) / F.sum(w), 1).alias("mean_gap_s"), rounded(F.max(g), 1).alias("max_gap_s"),
        rounded(100.0 * F.sum(F.when(g <= ON_TIME_FACTOR * nominal, w).otherwise(0)) / F.sum(w), 1)
        .alias("pct_within_2x_nominal"),
        F.sum(F.when(g > OUTAGE_FACTOR * nominal, w).otherwise(0)).alias("n_outage_gaps_gt10x"))
    files = arrivals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))
    stats = plain.join(quantiles.drop("n"), keys)
    return files.join(stats, keys, "left").select(
        *keys, "n_files", "n_gaps", rounded("median_gap_s", 1).alias("median_gap_s"), "mean_gap_s",
        rounded("p95_gap_s", 1).alias("p95_gap_s"), "max_gap_s", "pct_within_2x_nominal", "n_outage_gaps_gt10x",
        F.when(F.col("n_files") < 2, "insufficient data").otherwise("ok").alias("status"))


def throughput(files: DataFrame, nominal: Column, keys: Sequence[str] = ("source",),
               sample: int | None = None) -> DataFrame:
    """Records per file over all files of each source, or over its first `sample` files."""
    keys = list(keys)
    picked = files
    if sample is not None:
        first = F.row_number().over(W.partitionBy(*keys).orderBy("last_modified", "key"))
        picked = files.withColumn("_k", first).where(F.col("_k") <= sample)
    counted = picked.groupBy(*keys, "n_rows").agg(F.count(F.lit(1)).alias("_files"), F.max(nominal).alias("_nominal"))
    median = exact_quantiles(counted, keys, "n_rows", {"_median": 0.5}, "_files").drop("n")
    mean = F.sum(F.col("n_rows") * F.col("_files")) / F.sum("_files")
    plain = counted.groupBy(*keys).agg(
        F.sum("_files").alias("n_files_sampled"), rounded(mean, 1).alias("mean_records_per_file"),
        rounded(mean * (60.0 / F.max("_nominal")), 1).alias("records_per_min"),
        (mean * (60.0 / F.max("_nominal"))).alias("_per_min"))
    return plain.join(median, keys).select(
        *keys, "n_files_sampled", "mean_records_per_file", rounded("_median", 1).alias("median_records_per_file"),
        "records_per_min", "_per_min")


def files_per_cycle(files: DataFrame, nominal: Column, keys: Sequence[str] = ("source",), cycles: int = CYCLES,
                    min_files: int = MIN_CYCLE_FILES) -> DataFrame:
    """Files in a few cycles from the middle arrival, per cycle; null below the minimum of files."""
    keys = list(keys)
    timed = files.select(*keys, F.unix_micros(F.col("last_modified").cast("timestamp")).alias("_t"), nominal.alias("_i"))
    middle = order_statistics(timed, keys, "_t", {"_mid": (0.5, lambda n: F.floor(n / 2))})
    span = F.col("_t").between(F.col("_mid"), F.col("_mid") + F.col("_i") * (cycles * 1_000_000))
    return beside(timed, middle, keys).groupBy(*keys).agg(
        F.when(F.max("n") >= min_files, F.count_if(span) / F.lit(float(cycles))).alias("files_per_cycle"))


def throughput_stats(files: DataFrame, nominal: Column, keys: Sequence[str] = ("source",),
                     cycle_files: DataFrame | None = None, sample: int | None = None) -> DataFrame:
    """Throughput, and the records per minute over all files active in a cycle.

    `cycle_files` are the files of the sample day the cycles are counted on (default: all).
    """
    keys = list(keys)
    cycles = files_per_cycle(cycle_files if cycle_files is not None else files, nominal, keys)
    joined = throughput(files, nominal, keys, sample).join(cycles, keys, "left")
    return joined.withColumns({
        "aggregate_records_per_min": rounded(F.col("_per_min") * F.col("files_per_cycle"), 1),
        "files_per_cycle": rounded("files_per_cycle", 1),
    }).drop("_per_min")


def latencies(rows: DataFrame, event_epoch: Column, arrival: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds from event to arrival, kept in the plausible band."""
    late = F.unix_micros(arrival.cast("timestamp")) / F.lit(1e6) - event_epoch
    return rows.where(event_epoch > 0).select(*keys, late.alias("latency_s")).where(
        (F.col("latency_s") >= 0) & (F.col("latency_s") < MAX_LATENCY_SECONDS))


def latency_stats(samples: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Count, median, mean, 95th percentile and maximum, rounded to one digit."""
    keys = list(keys)
    plain = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), rounded(F.avg("latency_s"), 1).alias("mean_latency_s"),
        rounded(F.max("latency_s"), 1).alias("max_latency_s"))
    quantiles = exact_quantiles(samples, keys, "latency_s", {"median_latency_s": 0.5, "p95_latency_s": 0.95})
    return plain.join(quantiles.drop("n"), keys).select(
        *keys, "n_records", rounded("median_latency_s", 1).alias("median_latency_s"), "mean_latency_s",
        rounded("p95_latency_s", 1).alias("p95_latency_s"), "max_latency_s")
