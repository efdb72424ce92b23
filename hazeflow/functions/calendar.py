"""Time features of an event time (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(c: Column) -> Column:
    """Any timestamp type to TIMESTAMP; the session runs in UTC."""
    return c.cast("timestamp")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(event_time(ts))


def calendar_columns(ts: Column) -> dict[str, Column]:
    """hour, day, month and day_of_week (Monday is 0), as 64-bit integers."""
    return {
        "hour": F.hour(ts).cast("bigint"),
        "day": F.dayofmonth(ts).cast("bigint"),
        "month": F.month(ts).cast("bigint"),
        "day_of_week": F.weekday(ts).cast("bigint"),
    }
