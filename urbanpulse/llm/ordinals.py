"""Consecutive numbers along a sorted table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.session import materialise

PLACE_BITS = 33  # of monotonically_increasing_id: place inside a partition; the bits above are the partition


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows in a total order, numbered from 0 in `name`; written once, so that the order is settled.

    Range partitions are sorted side by side; the number of rows before each of them is one short row a partition.
    """
    sorted_rows = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS)
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    before, starts = 0, []
    for r in sorted(counts):
        starts.append((r["_part"], before))
        before += r["_n"]
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))  # a row for each partition
    placed = sorted_rows.withColumn("_part", part).join(first, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_at", "_part", "_before")
