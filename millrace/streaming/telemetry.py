"""Streaming counterparts of the pipeline. They extend the batch semantics and differ where noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import models
from millrace.schemas import BRONZE
from millrace.sources.state import StateTable, upsert


def landed(spark: SparkSession, path: str, name: str = "bronze_device_events") -> DataFrame:
    """A stream over a landing folder of Parquet files."""
    return spark.readStream.schema(BRONZE[name]).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", lateness: str = "3 days") -> DataFrame:
    """Events per machine, type and window. The watermark follows the latest event of all keys."""
    stamped = events.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    counted = stamped.withWatermark("event_timestamp", lateness).groupBy(
        F.window("event_timestamp", window), "machine_id", "event_type_code"
    ).agg(F.count(F.lit(1)).alias("event_count"))
    return counted.select(
        "machine_id", "event_type_code", F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), "event_count"
    )


def once_within(events: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Messages once each within the watermark; keeps the first copy, where the batch keeps the best."""
    stamped = events.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    return stamped.withWatermark("event_timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str = "3 days") -> DataFrame:
    """Sessions per machine. A gap of exactly ``gap`` begins a new one here, unlike in batch."""
    stamped = events.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    found = stamped.withWatermark("event_timestamp", lateness).groupBy(
        F.session_window("event_timestamp", gap), "machine_id"
    ).agg(
        F.min("event_timestamp").alias("session_start"), F.max("event_timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return found.drop("session_window")


def conform_into(events: DataFrame, state: StateTable, checkpoint: str) -> StreamingQuery:
    """Keeps the latest delivery of every event in ``state``, batch by batch, last write wins.

    A batch that runs again after a failure changes nothing, as it is an upsert of the same rows. Only the
    buckets of ``state`` that hold the batch's events are read and written, if it has ``event_id`` as its key.
    """

    def merge(batch: DataFrame, _: int) -> None:
        # What the batch holds meets the stored copies of the same events, so an older delivery never wins.
        def make(old: DataFrame) -> DataFrame:
            touched = old.join(batch.select("event_id").distinct(), "event_id", "left_semi").select(*old.columns)
            best = models.conformed_events(touched.unionByName(batch.select(*old.columns)))
            return upsert(old, best.select(*old.columns), ["event_id"])

        if state.keys == ["event_id"]:
            state.change_keys(batch, make)
        else:
            state.change(make)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
