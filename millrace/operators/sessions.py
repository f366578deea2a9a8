"""Sessions of activity separated by gaps.

A window lag flags gaps above the threshold, the running sum of the flags numbers the sessions, and
an aggregate closes them. This runs twice: first inside slices of time of each user, then over the
few fragments the slices leave. A slice of ``slice_s`` seconds leaves at most ``slice_s / gap_s + 1``
fragments, whatever its number of events, so the second window is bounded by time, and a user with a
third of all rows is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.temporal import from_micros, micros


def _numbered(df: DataFrame, keys: list[str], start: str, end: str, gap_us: int) -> DataFrame:
    """``df`` with ``_no``: rows of ``keys`` more than ``gap_us`` after the row before begin a new number."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    flag = F.when(F.col(start) - F.lag(end).over(order) > gap_us, 1).otherwise(0)
    running = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # ties get one number
    return df.withColumn("_flag", flag).withColumn("_no", F.sum("_flag").over(running)).drop("_flag")


def _fragments(df: DataFrame, keys: list[str], ts: str, gap_s: int, slice_s: int, extra: list[str]) -> DataFrame:
    present = F.col(ts).isNotNull()
    for key in keys:
        present &= F.col(key).isNotNull()
    cut = df.filter(present).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        micros(F.col(ts)).alias("_us"),
        *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)],
    )
    cut = cut.withColumn("_slice", F.floor(F.col("_us") / (slice_s * 1_000_000)))
    ks = [f"_k{i}" for i in range(len(keys))]
    return _numbered(cut, [*ks, "_slice"], "_us", "_us", gap_s * 1_000_000)


def sessions(
    df: DataFrame, keys: list[str], ts: str, gap_s: int = 1800, slice_s: int = 14_400
) -> DataFrame:
    """One row per session: keys, session_no, session_start, session_end, duration_seconds, event_count.

    Rows more than ``gap_s`` seconds after the row before them begin a session; exactly ``gap_s`` does
    not. Rows at the same instant, repeated rows among them, belong to one session and all count.
    Rows with a null key or instant belong to none. An empty table has no session.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    part = _fragments(df, keys, ts, gap_s, slice_s, []).groupBy(*ks, "_slice", "_no")
    part = part.agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count(F.lit(1)).alias("_n")).drop("_no")
    whole = _numbered(part, ks, "_from", "_to", gap_s * 1_000_000).groupBy(*ks, "_no")
    whole = whole.agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"))
    return whole.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        (F.col("_no") + 1).alias("session_no"),
        from_micros(F.col("_from")).alias("session_start"),
        from_micros(F.col("_to")).alias("session_end"),
        ((F.col("_to") - F.col("_from")) / 1_000_000).alias("duration_seconds"),
        F.col("_n").alias("event_count"),
    )


def session_kinds(
    df: DataFrame, keys: list[str], ts: str, kind: str, gap_s: int = 1800, slice_s: int = 14_400
) -> DataFrame:
    """One row per session and value of ``kind``: the session's columns and ``kind_count``.

    Rows of a null ``kind`` are counted under null. Everything else is as in ``sessions``.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    part = _fragments(df, keys, ts, gap_s, slice_s, [kind]).groupBy(*ks, "_slice", "_no", "_x0")
    part = part.agg(F.min("_us").alias("_kfrom"), F.max("_us").alias("_kto"), F.count(F.lit(1)).alias("_kn"))
    # The kinds of one fragment share its extent.
    fragment = Window.partitionBy(*ks, "_slice", "_no")
    part = part.withColumn("_from", F.min("_kfrom").over(fragment)).withColumn("_to", F.max("_kto").over(fragment))
    whole = _numbered(part.drop("_no"), ks, "_from", "_to", gap_s * 1_000_000)
    session = Window.partitionBy(*ks, "_no")
    whole = whole.groupBy(*ks, "_no", "_x0").agg(
        F.min("_from").alias("_f"), F.max("_to").alias("_t"), F.sum("_kn").alias("_n")
    )
    start, end = F.min("_f").over(session), F.max("_t").over(session)
    return whole.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        (F.col("_no") + 1).alias("session_no"),
        from_micros(start).alias("session_start"),
        from_micros(end).alias("session_end"),
        F.col("_x0").alias(kind),
        F.col("_n").alias("kind_count"),
    )
