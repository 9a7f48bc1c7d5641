"""Clock arithmetic on columns. The session time zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanpulse.fixed import (
    MAX_PLAUSIBLE_EPOCH,
    MICROSECOND_EPOCH_ABOVE,
    MILLISECOND_EPOCH_ABOVE,
    MIN_PLAUSIBLE_EPOCH,
    PEAK_HOURS,
)

_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def iso_timestamp(text: Column, fraction: bool = False) -> Column:
    """ISO date-time with zone to an instant; anything else is null."""
    shape = _ISO + (r"(\.\d+)?" if fraction else "") + _ZONE
    return F.when(text.rlike(shape), text.try_cast("timestamp"))


def as_instant(ts: Column) -> Column:
    """Zone-less times are read as UTC; instants stay as they are."""
    return ts.cast("timestamp")


def bucket(ts: Column, unit: str = "minute") -> Column:
    return F.date_trunc(unit, ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(6e7)


def epoch_seconds(raw: Column) -> Column:
    """Epoch of unknown unit to whole seconds, told apart by size."""
    n = raw.try_cast("double")
    return (
        F.when(n > MICROSECOND_EPOCH_ABOVE, (n / 1e6).try_cast("bigint"))
        .when(n > MILLISECOND_EPOCH_ABOVE, (n / 1e3).try_cast("bigint"))
        .otherwise(n.try_cast("bigint"))
    )


def after_2000(raw: Column) -> Column:
    """True for an epoch in seconds later than the year 2000; null counts as false."""
    return F.coalesce(raw.try_cast("double") > MIN_PLAUSIBLE_EPOCH, F.lit(False))


def plausible_epoch(sec: Column) -> Column:
    return sec.between(MIN_PLAUSIBLE_EPOCH, MAX_PLAUSIBLE_EPOCH)


def date_epoch(day: Column) -> Column:
    """Midnight UTC of a date in epoch seconds."""
    return F.unix_date(day).cast("bigint") * 86400


def service_date(text: Column) -> Column:
    """`YYYYMMDD` to a date, null when it is not one."""
    return F.try_to_timestamp(text.cast("string"), F.lit("yyyyMMdd")).cast("date")


def clock_seconds(text: Column) -> Column:
    """`H:M:S` to seconds; hours may pass 24, missing or bad parts count as 0."""
    part = F.split(text, ":")

    def number(i: int) -> Column:
        return F.coalesce(F.get(part, F.lit(i)).try_cast("int").cast("bigint"), F.lit(0))

    return number(0) * 3600 + number(1) * 60 + number(2)


def service_departure(start_date: Column, start_time: Column, service_tz: str | None = None) -> Column:
    """Departure epoch of a trip: service date plus clock, else service midnight.

    The clock is taken as UTC; name `service_tz` to read it as local time of that zone.
    """
    midnight = date_epoch(service_date(start_date))
    seconds = midnight + clock_seconds(start_time)
    if service_tz:
        local = F.timestamp_seconds(seconds)
        seconds = F.unix_seconds(F.to_utc_timestamp(local, service_tz))
    timed = F.when(F.char_length(F.coalesce(start_time, F.lit(""))) > 0, seconds)
    return F.when(timed > 0, timed).otherwise(F.coalesce(midnight, timed))


def snapshot_epoch(folder_date: Column, path: Column) -> Column:
    """Epoch from a file name ending `_HHMMSS.parquet` in a dated folder; null when out of range."""
    digits = F.regexp_extract(path, r"(?i)_(\d{6})\.parquet$", 1)
    h, m, s = (F.substring(digits, 1 + 2 * i, 2).try_cast("int") for i in range(3))
    inside = (h < 24) & (m < 60) & (s < 60)
    return F.when(inside, date_epoch(folder_date) + h * 3600 + m * 60 + s)


def folder_date(path: Column, modified: Column | None = None) -> Column:
    """First path part that is a real `YYYY-MM-DD` date, else the modification date."""
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    real = F.filter(F.transform(parts, lambda p: p.try_cast("date")), lambda d: d.isNotNull())
    named = F.get(real, F.lit(0))
    return named if modified is None else F.coalesce(named, modified.cast("date"))


def is_weekday(ts: Column) -> Column:
    return F.weekday(ts) < 5


def is_peak(ts: Column) -> Column:
    """Monday to Friday in the rush hours."""
    return is_weekday(ts) & F.hour(ts).isin(*PEAK_HOURS)
