"""Time windows: single filters and named, possibly overlapping periods."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.fixed import Period
from urbanpulse.functions.times import is_weekday

# Longer lists are joined as a table instead of being tested inside the row.
MAX_LITERAL_PERIODS = 200


def window_bounds(start: datetime | None, end: datetime | None, period_days: int | None = None,
                  now: datetime | None = None) -> tuple[datetime, datetime]:
    """Both ends of a window: the end defaults to now, the start to 1970, days count back from the end."""
    end = end or now or datetime.now(timezone.utc)
    if period_days is not None:
        start = end - timedelta(days=period_days)
    start = start or datetime(1970, 1, 1)
    return tuple(d if d.tzinfo else d.replace(tzinfo=timezone.utc) for d in (start, end))


def day_end(text: str) -> datetime:
    """An end given as a plain date means its last microsecond."""
    text = text.strip()
    if len(text) <= 10:
        day = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
        return day + timedelta(days=1) - timedelta(microseconds=1)
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def instant(moment: datetime) -> Column:
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return F.lit(moment.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def in_window(ts: Column, start: datetime, end: datetime, weekday_only: bool = False,
              weekend_only: bool = False) -> Column:
    """Inclusive at both ends; weekdays win when both flags are set."""
    keep = ts.between(instant(start), instant(end))
    if weekday_only:
        return keep & is_weekday(ts)
    return keep & ~is_weekday(ts) if weekend_only else keep


def part_of_day(ts: Column, first_hour: int, last_hour: int) -> Column:
    """Hours from the first up to, not including, the last."""
    return (F.hour(ts) >= first_hour) & (F.hour(ts) < last_hour)


def effective_time(feed: str) -> Column:
    """The column a feed is filtered and placed by."""
    if feed == "trips":
        return F.coalesce(F.timestamp_seconds("departure_timestamp"), F.timestamp_seconds("timestamp"))
    return F.col({"travel_times": "period_start", "situations": "minute"}.get(feed, "timestamp")).cast("timestamp")


def with_periods(df: DataFrame, ts: Column, periods: Sequence[Period], folder: Column | None = None) -> DataFrame:
    """A row goes to every period it falls in, as column `period`.

    Periods are a short literal list, tested inside the row: no join and no shuffle. The overall
    span is also a plain filter on the time, so it reaches the scan. With `folder`, the folder
    date must lie inside the period as well.
    """
    if len(periods) > MAX_LITERAL_PERIODS:
        rows = [(p.name, p.start, p.end, p.weekday_only, p.weekend_only) for p in (utc_period(p) for p in periods)]
        long = df.sparkSession.createDataFrame(
            rows, "name string, start_date timestamp, end_date timestamp, weekday_only boolean, weekend_only boolean")
        return with_period_table(df, ts, long, folder)

    def name_if_inside(p: Period) -> Column:
        inside = in_window(ts, p.start, p.end, p.weekday_only, p.weekend_only)
        if folder is not None:
            inside = inside & folder.between(instant(p.start).cast("date"), instant(p.end).cast("date"))
        return F.when(inside, F.lit(p.name))

    span = ts.between(instant(min(p.start for p in periods)), instant(max(p.end for p in periods)))
    names = F.array_compact(F.array(*[name_if_inside(p) for p in periods]))
    return df.where(span).withColumn("period", F.explode(names))


def utc_period(p: Period) -> Period:
    """The period with its time zone named, as Python's own clocks would otherwise read it as local."""
    aware = lambda d: d if d.tzinfo else d.replace(tzinfo=timezone.utc)
    return replace(p, start=aware(p.start), end=aware(p.end))


def with_period_table(df: DataFrame, ts: Column, periods: DataFrame, folder: Column | None = None) -> DataFrame:
    """Long period tables (name, start_date, end_date, flags): an equi join on days, then the exact test."""
    days = periods.withColumn(
        "_day", F.explode(F.sequence(F.col("start_date").cast("date"), F.col("end_date").cast("date")))
    )
    flag = {c: F.coalesce(F.col(c), F.lit(False)) if c in periods.columns else F.lit(False)
            for c in ("weekday_only", "weekend_only")}
    weekday = is_weekday(F.col("_ts"))
    keep = (
        F.col("_ts").between(F.col("start_date"), F.col("end_date"))
        & F.when(flag["weekday_only"], weekday).when(flag["weekend_only"], ~weekday).otherwise(True)
    )
    own = {"_ts": ts, "_day": ts.cast("date")} | ({"_folder": folder} if folder is not None else {})
    if folder is not None:
        keep = keep & F.col("_folder").between(F.col("start_date").cast("date"), F.col("end_date").cast("date"))
    joined = df.withColumns(own).join(days, "_day").where(keep)
    return joined.select(*df.columns, F.col("name").alias("period"))
