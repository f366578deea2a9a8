"""The next row of a key in time, for keys that may hold a third of all rows.

A window over a whole key would sort that key in one task. Here rows are ordered inside slices of time
of each key; only the first and last rows of the slices, two a slice, meet in a window over the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE, NEXT, FIRST = "_nb_slice", "_nb_next", "_nb_first"


def with_next(df: DataFrame, keys: list[str], ts: str, ties: list[str], carry: dict[str, str]) -> DataFrame:
    """``df`` with columns of the next row of the same keys by ``ts``, then ``ties``.

    ``carry`` maps each new column to the column of the next row that it shows; the last row of a key gets
    null. Null keys are a key of their own; rows without ``ts`` come first. Slices are days.
    """
    taken = F.struct(*[F.col(source).alias(name) for name, source in carry.items()])
    order = Window.partitionBy(*keys, SLICE).orderBy(ts, *ties)
    near = df.withColumn(SLICE, F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date")))
    near = near.withColumns({NEXT: F.lead(taken).over(order), FIRST: F.row_number().over(order) == 1})
    # Both branches read one exchange.
    inner = near.filter(F.col(NEXT).isNotNull())
    edges = near.filter(F.col(NEXT).isNull() | F.col(FIRST))
    later = Window.partitionBy(*keys).orderBy(SLICE, F.col(NEXT).isNull())
    last = edges.withColumn("_nb_later", F.lead(taken).over(later)).filter(F.col(NEXT).isNull())
    last = last.withColumn(NEXT, F.col("_nb_later")).drop("_nb_later")
    return inner.unionByName(last).select(*df.columns, *[F.col(f"{NEXT}.{name}").alias(name) for name in carry])
