"""Time expressions on TIMESTAMP_NTZ columns, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("minute", "hour", "day")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp (UTC); null for null."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    """The TIMESTAMP_NTZ of microseconds since 1970."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole-second boundaries crossed from ``start`` to ``end``."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def bucket(ts: Column, grain: str) -> Column:
    """Start of the minute, hour or day of ``ts``."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def day_text(day: Column) -> Column:
    """A date as YYYY-MM-DD."""
    return F.date_format(day, "yyyy-MM-dd")
