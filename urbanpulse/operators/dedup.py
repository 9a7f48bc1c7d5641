"""Keep-last deduplication as a maximum, not a window.

A window would bring every copy of a key to one task. `max_by` combines before the
shuffle, so a key that holds a third of all rows arrives as one row per map task.
Nulls are a key like any other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.sources.snapshots import FILE, FILE_TIME, FOLDER_DATE, ROW


def keep_last(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """The row with the greatest order per key. The order should be total, or ties pick any row."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def latest_flights(raw: DataFrame) -> DataFrame:
    """One row per flight id and folder date: newest file, then last position in it."""
    if "uniqueID" not in raw.columns:
        return raw
    return keep_last(raw, ["uniqueID", FOLDER_DATE], [FILE_TIME, FILE, ROW])


def latest_trips(trips: DataFrame, clock: str = "departure_timestamp") -> DataFrame:
    """One row per trip, route, departure and folder date: last file by name."""
    keys = ["trip_id", "route_id", clock, FOLDER_DATE]
    ties = [c for c in ("timestamp", "max_departure_delay_sec", "max_arrival_delay_sec") if c != clock]
    return keep_last(trips, keys, [FILE, *ties])


def dedup_clock(trips: DataFrame) -> str:
    """Departure, unless no row has one."""
    return "timestamp" if trips.where(F.col("departure_timestamp").isNotNull()).isEmpty() else "departure_timestamp"
