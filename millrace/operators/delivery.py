"""Exactly one copy of every message that was delivered at least once.

Identifiers are split by their frequency, which a scan of the identifiers alone counts with map-side
partial sums. Hashes of the repeated ones are set in a bitmap of fixed size, which is sent to all tasks.
A message whose bit is not set is a singleton for certain and passes where it was read; the rest,
repeated ones and the few singletons that share a bit with them, are ranked by identifier. Both results
are united.

An identifier may hold a third of all rows: the count is summed and the rank is cut to its first row
inside every task, so each task sends one row of it. No join meets rows before they are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID, N = "_msg_id", "_msg_copies"
#: The identifier as it is worked with: never null, empty for none. So the planner infers no filters on it, which
#: would work it out again and keep branches from sharing an exchange.
KEY = "_msg_key"
_OWN = (ID, N, KEY, "_msg_rank", "_msg_bucket", "_msg_bits")
#: Bits of one bitmap, as Spark's bitmap functions define it, and number of bitmaps: 16 MB, whatever the data.
BUCKET_BITS = 32_768
BUCKETS = 4_096


def _keyed(df: DataFrame, identity: Column) -> DataFrame:
    """``df`` with its KEY; columns under the operator's own names are replaced."""
    return df.drop(*_OWN).withColumn(KEY, F.coalesce(F.concat(F.lit("="), identity.cast("string")), F.lit("")))


def _repeated(keyed: DataFrame) -> DataFrame:
    """Identifiers that two or more rows carry, with their frequency."""
    return keyed.groupBy(KEY).agg(F.count(F.when(F.col(KEY) != "", 1)).alias(N)).filter(F.col(N) > 1)


def _place() -> Column:
    """The bit of an identifier, from 1; 0, which is in no bitmap, for none."""
    return F.when(F.col(KEY) == "", 0).otherwise(F.pmod(F.xxhash64(KEY), F.lit(BUCKETS * BUCKET_BITS)) + 1)


def _bucket() -> Column:
    """The bitmap of an identifier; never null, for the reason given at KEY."""
    return F.coalesce(F.bitmap_bucket_number(_place()), F.lit(0).cast("bigint"))


def _bitmaps(repeated: DataFrame) -> DataFrame:
    """BUCKETS rows, whatever the data, with the bits of the repeated identifiers, and the first of each bitmap."""
    every = repeated.sparkSession.range(1, BUCKETS + 1).select(F.col("id").alias("_msg_bucket"), F.lit(0).cast("bigint").alias("_at"))
    placed = repeated.select(_bucket().alias("_msg_bucket"), F.bitmap_bit_position(_place()).alias("_at")).unionByName(every)
    # Only places move; bitmaps are made once each, where their places meet.
    placed = placed.repartition("_msg_bucket")
    return placed.groupBy("_msg_bucket").agg(F.bitmap_construct_agg("_at").alias("_msg_bits"))


def _is_set() -> Column:
    """Whether the bit of an identifier is set in ``_msg_bits``."""
    at = F.bitmap_bit_position(_place())
    byte = F.conv(F.hex(F.substring("_msg_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1


def _split(keyed: DataFrame, repeated: DataFrame, how: str) -> DataFrame:
    """The rows that may be repeated (``left_semi``), or those that are not for certain (``left_anti``)."""
    maps = F.broadcast(_bitmaps(repeated))  # BUCKETS rows of BUCKET_BITS bits at most
    return keyed.join(maps, (_bucket() == F.col("_msg_bucket")) & _is_set(), how)


def _ranked(keyed: DataFrame, repeated: DataFrame, order: list[Column], how: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    first = _split(keyed, repeated, "left_semi").withColumn("_msg_rank", rank).filter(F.col("_msg_rank") == 1)
    # Both sides lie by identifier already.
    return first.join(repeated, KEY, how)


def _told(rows: DataFrame, df: DataFrame) -> DataFrame:
    own = F.when(F.col(KEY) != "", F.substring(KEY, 2, 1 << 30)).alias(ID)
    return rows.select(*[c for c in df.columns if c not in _OWN], own, N)


def ranked_repeats(df: DataFrame, identity: Column, order: list[Column]) -> DataFrame:
    """The kept row of each identifier that two or more rows carry, with ``_msg_id`` and ``_msg_copies``.

    ``order`` ranks the copies, best first. Copies that tie in all of ``order`` are alike to it and any
    one of them is kept. An empty table and one without repeated identifiers give no row.
    """
    keyed = _keyed(df, identity)
    return _told(_ranked(keyed, _repeated(keyed), order, "inner"), df)


def exactly_once(df: DataFrame, identity: Column, order: list[Column]) -> DataFrame:
    """``df`` with one row of each identifier, and ``_msg_id`` and ``_msg_copies`` after its columns.

    Rows without identifier (null) can not be told to be copies and all stay, with ``_msg_copies`` 1. The
    table is read three times, once for its identifiers alone, as what passes and what is ranked come
    from it apart; in return nothing of a singleton moves. ``df`` must give the same rows each time.
    """
    keyed = _keyed(df, identity)
    repeated = _repeated(keyed)
    one = F.lit(1).cast("bigint")
    single = _split(keyed, repeated, "left_anti").withColumn(N, one)
    ranked = _ranked(keyed, repeated, order, "left").withColumn(N, F.coalesce(N, one))
    return _told(single.unionByName(ranked.select(*single.columns)), df)


def exactly_once_incremental(
    stored: DataFrame, new: DataFrame, identity: Column, order: list[Column]
) -> DataFrame:
    """``exactly_once`` over what is stored and what has just arrived; both need the same columns.

    The stored side may itself be the result of an earlier call without its ``_msg`` columns.
    """
    return exactly_once(stored.unionByName(new), identity, order)
