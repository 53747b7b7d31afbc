"""Time arithmetic on TIMESTAMP_NTZ that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a zone-less timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def hours_between(start, end) -> Column:
    return (epoch_seconds(end) - epoch_seconds(start)) / F.lit(3600.0)


def plus_hours(ts, hours) -> Column:
    """ts + hours, where hours is an int or an integer column."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return ts + F.make_dt_interval(hours=hours)
