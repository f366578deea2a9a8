"""Figures by event time that are put right as late records arrive, up to a cut-off.

Records are first reduced to partial aggregates per key, hour of the event and load (map-side), so
what reaches one key's task is bounded by hours and loads, not by its records. The loads of a key are
then played in order into a ``FingerTree`` keyed by hour; after each load the periods it touched are
read off again, and hours past the cut-off are evicted in bulk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.finger_tree import FingerTree

HOURS = 24
UNIT = (0, 0, None, None)


def _combine(a: tuple, b: tuple) -> tuple:
    low = b[2] if a[2] is None else a[2] if b[2] is None or a[2] <= b[2] else b[2]
    high = b[3] if a[3] is None else a[3] if b[3] is None or a[3] >= b[3] else b[3]
    return a[0] + b[0], a[1] + b[1], low, high


_NAMES = ["key", "period", "load", "revision", "events", "total", "least", "most"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _play(cutoff_days: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _NAMES]
        key = load = tree = None
        touched: set[int] = set()
        revisions: dict[int, int] = {}

        def report() -> None:
            for day in sorted(touched):
                revisions[day] = revisions.get(day, -1) + 1
                figures = tree.span(day * HOURS, (day + 1) * HOURS)
                for column, value in zip(out, (key, day, load, revisions[day], *figures)):
                    column.append(value)
            touched.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS)], _NAMES)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for k, at, hour, n, total, least, most in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, at) != (key, load):
                    report()
                    if k != key:
                        key, tree, revisions = k, FingerTree(_combine, UNIT), {}
                    load = at
                    oldest = load - cutoff_days
                    tree.evict(oldest * HOURS)
                    for day in [d for d in revisions if d < oldest]:
                        del revisions[day]
                tree.insert(hour, (n, total, least, most))
                touched.add(hour // HOURS)
            if len(out[0]) > 20_000:
                yield flush()
        report()
        yield flush()

    return run


def corrected_periods(
    records: DataFrame, identity: Column, key: Column, event_ts: Column, seen_ts: Column, load_date: Column,
    total: Column, reading: Column, cutoff_days: int = 3,
) -> DataFrame:
    """Daily figures per key after every load that changes them.

    Columns: key, event_day, load_day (dates), revision (0: first report, then 1, 2, ...),
    event_count, total (sum of ``total``, bigint), least and most (of ``reading``).

    Records without key, with an instant missing, or that happened after they were seen do not count.
    Records of one ``identity`` count once, at the smallest load date of those that count (ties: seen
    first, then the least key and instant); records without identity each count. One that comes more
    than ``cutoff_days`` days after its day is left out. Null ``total`` adds nothing, null ``reading``
    neither. An empty table gives no row.
    """
    counted = records.select(
        identity.alias("id"), key.alias("key"), event_ts.alias("ts"), seen_ts.alias("seen"),
        load_date.cast("date").alias("load"), total.cast("bigint").alias("total"), reading.cast("double").alias("reading"),
    ).filter(F.col("key").isNotNull() & F.col("load").isNotNull() & (F.col("ts") <= F.col("seen")))
    # Records without identity get one of their own, by their place in the input.
    own = F.coalesce("id", F.concat(F.lit("row/"), F.monotonically_increasing_id().cast("string")))
    one = F.struct("load", "seen", "key", "ts", "total", "reading")
    once = counted.groupBy(own.alias("id")).agg(F.min(one).alias("r")).select("r.*")
    day = F.to_date("ts")
    in_time = once.filter(F.datediff("load", day) <= cutoff_days).select(
        "key",
        F.unix_date("load").cast("bigint").alias("load"),
        (F.unix_date(day).cast("bigint") * HOURS + F.hour("ts")).alias("hour"),
        "total",
        "reading",
    )
    partial = in_time.groupBy("key", "load", "hour").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("total"), F.lit(0).cast("bigint")).alias("total"),
        F.min("reading").alias("least"),
        F.max("reading").alias("most"),
    )
    ordered = partial.repartition("key").sortWithinPartitions("key", "load", "hour")
    schema = "key string, period bigint, load bigint, revision int, events bigint, total bigint, least double, most double"
    return ordered.mapInArrow(_play(cutoff_days), schema).select(
        "key",
        F.date_from_unix_date(F.col("period").cast("int")).alias("event_day"),
        F.date_from_unix_date(F.col("load").cast("int")).alias("load_day"),
        "revision",
        F.col("events").alias("event_count"),
        "total",
        "least",
        "most",
    )
