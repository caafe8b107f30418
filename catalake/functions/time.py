"""Time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_part(iso: Column) -> Column:
    """The local date of an ISO string, which is its first ten characters."""
    return F.regexp_extract(F.coalesce(iso, F.lit("")), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)


def event_time(ts: Column, day: Column, end_of_day: bool = False) -> Column:
    """The parsed time, else the day's start or end, else the epoch."""
    fallback = F.concat(day, F.lit("T23:59:59Z" if end_of_day else "T00:00:00Z"))
    return F.coalesce(F.try_to_timestamp(ts), F.try_to_timestamp(fallback), F.timestamp_seconds(F.lit(0)))


def nearest_hour(ts: Column, zone: str = "America/Vancouver") -> Column:
    """Rounded to the hour and shown in a zone: long month, day, and time with am or pm."""
    local = F.from_utc_timestamp(F.date_trunc("hour", ts + F.expr("interval 30 minutes")), zone)
    return F.concat(F.date_format(local, "MMMM d h:mm"), F.lower(F.date_format(local, "a")))


def file_safe(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def in_window(ts: Column, now: Column, hours: int) -> Column:
    """Within the last hours, both ends included."""
    return ts.between(now - F.expr(f"interval {hours} hours"), now)
