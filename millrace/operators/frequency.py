"""Event frequency per key and time bucket, with a high-water mark.

Gaps between successive events need no window over the events: inside a bucket they add up to the time
from the last event of the bucket before to the bucket's own last, so a partial aggregate per bucket and
a lag over buckets give exact averages. A hot key is thus reduced before anything moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.temporal import bucket, from_micros, micros, seconds_between

KEYS = ["machine_id", "event_type_code"]
EPOCH = "1900-01-01 00:00:00"
MARK = "last_processed_event_timestamp"


def newer_than(events: DataFrame, watermark: DataFrame | None) -> DataFrame:
    """Events later than their key's mark; all of a key without mark. Null keys have none."""
    if watermark is None:
        return events
    marks = watermark.select(*[F.col(k).alias(f"_w_{k}") for k in KEYS], F.col(MARK).alias("_mark"))
    on = [F.col(k) == F.col(f"_w_{k}") for k in KEYS]
    start = F.coalesce(F.col("_mark"), F.lit(EPOCH).cast("timestamp_ntz"))
    return events.join(marks, on, "left").filter(F.col("event_timestamp") > start).select(*events.columns)


def late(events: DataFrame, watermark: DataFrame) -> DataFrame:
    """Events at or before their key's mark: those a run from it will never see."""
    marks = watermark.select(*KEYS, F.col(MARK).alias("_mark"))
    return events.join(marks, KEYS).filter(F.col("event_timestamp") <= F.col("_mark")).select(*events.columns)


def partials(events: DataFrame, grain: str) -> DataFrame:
    """Mergeable aggregates per key and bucket; see ``finish``."""
    value, ts = F.col("event_value"), F.col("event_timestamp")
    return events.filter(ts.isNotNull()).groupBy(*KEYS, bucket(ts, grain).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min(ts).alias("first_event_timestamp"),
        F.max(ts).alias("last_event_timestamp"),
        # Nulls are least: they win the minimum and lose the maximum; the earlier instant breaks ties.
        F.min(F.struct(value.alias("v"), micros(ts).alias("t"))).alias("_least"),
        F.max(F.struct(value.alias("v"), (-micros(ts)).alias("t"))).alias("_most"),
    )


def coarser(parts: DataFrame, grain: str) -> DataFrame:
    """``partials`` of a finer grain merged to a coarser one."""
    return parts.groupBy(*KEYS, bucket(F.col("bucket_start"), grain).alias("bucket_start")).agg(
        F.sum("event_count").alias("event_count"),
        F.min("first_event_timestamp").alias("first_event_timestamp"),
        F.max("last_event_timestamp").alias("last_event_timestamp"),
        F.min("_least").alias("_least"),
        F.max("_most").alias("_most"),
    )


def finish(parts: DataFrame) -> DataFrame:
    """The frequency table of ``partials``; the first event of a key has no gap."""
    order = Window.partitionBy(*KEYS).orderBy("bucket_start")
    before = F.lag("last_event_timestamp").over(order)
    last, first, n = F.col("last_event_timestamp"), F.col("first_event_timestamp"), F.col("event_count")
    inside = seconds_between(F.coalesce(before, first), last)
    gaps = F.when(before.isNull(), n - 1).otherwise(n)
    return parts.select(
        *KEYS, "bucket_start", "event_count", "first_event_timestamp", "last_event_timestamp",
        from_micros(F.col("_least.t")).alias("timestamp_of_min_value"),
        from_micros(-F.col("_most.t")).alias("timestamp_of_max_value"),
        F.when(gaps > 0, inside / gaps).alias("avg_seconds_between_events"),
    )


def event_frequency(events: DataFrame, grain: str, watermark: DataFrame | None = None) -> DataFrame:
    """Count, first, last, instants of the least and greatest value and mean gap per key and bucket.

    Only events newer than ``watermark`` count, and gaps begin with the first of them.
    """
    return finish(partials(newer_than(events, watermark), grain))


def advance(watermark: DataFrame, output: DataFrame) -> DataFrame:
    """``watermark`` moved to the last event of ``output`` per key; keys without mark are not added."""
    new = output.groupBy(*KEYS).agg(F.max("last_event_timestamp").alias("_new"))
    moved = watermark.join(new, KEYS, "left")
    return moved.withColumn(MARK, F.coalesce("_new", MARK)).select(*watermark.columns)
