"""Joins of instants and days with validity intervals [from, to), open where ``to`` is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.temporal import seconds_between


def day_spine(bounds: DataFrame, first: str, last: str, name: str = "day") -> DataFrame:
    """One row per day from ``first`` to ``last`` of each row of ``bounds``; none where either is null."""
    days = bounds.filter(F.col(first) <= F.col(last))
    return days.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias(name))


def by_day(intervals: DataFrame, start: str, end: str, until: Column, name: str = "day") -> DataFrame:
    """``intervals`` once per day they touch; open ones end at ``until``.

    An interval that ends at midnight does not touch the day that begins then; empty ones touch none.
    """
    closed = intervals.withColumn("_end", F.coalesce(F.col(end), until))
    closed = closed.filter(F.col("_end") > F.col(start))
    last = F.to_date(F.col("_end") - F.expr("interval 1 microsecond"))
    days = F.sequence(F.to_date(start), last, F.expr("interval 1 day"))
    return closed.withColumn(name, F.explode(days)).drop("_end")


def seconds_in_day(start: Column, end: Column, day: Column) -> Column:
    """Seconds of [start, end) that lie in ``day``."""
    opens = day.cast("timestamp_ntz")
    closes = opens + F.expr("interval 1 day")
    return F.greatest(F.lit(0), seconds_between(F.greatest(start, opens), F.least(end, closes)))


def as_of(
    facts: DataFrame, versions: DataFrame, keys: list[str], ts: str, start: str, end: str, how: str = "left"
) -> DataFrame:
    """Each fact with the columns of the version in force at its ``ts``.

    ``versions`` names its columns apart from ``facts``, except ``keys``. Both sides meet on (keys, day), so
    a key with a third of all facts is spread over its days; open versions are spread over the days on
    which their key has facts, so a wrong clock far ahead costs one row. Facts without keys, instant or version keep nulls (``left``) or drop out (``inner``).
    """
    closed = by_day(versions.filter(F.col(end).isNotNull()), start, end, F.col(end), "_day")
    held = facts.select(*keys, F.to_date(ts).alias("_day")).dropna().distinct()
    still = versions.filter(F.col(end).isNull()).join(held, keys).filter(F.col("_day") >= F.to_date(start))
    spread = closed.unionByName(still)
    f, v = facts.withColumn("_day", F.to_date(ts)).alias("f"), spread.alias("v")
    on = F.col("f._day") == F.col("v._day")
    for k in keys:
        on &= F.col(f"f.{k}") == F.col(f"v.{k}")
    on &= (F.col(f"f.{ts}") >= F.col(f"v.{start}")) & (F.col(f"v.{end}").isNull() | (F.col(f"f.{ts}") < F.col(f"v.{end}")))
    extra = [c for c in versions.columns if c not in keys]
    return f.join(v, on, how).select("f.*", *[F.col(f"v.{c}") for c in extra]).drop("_day")
