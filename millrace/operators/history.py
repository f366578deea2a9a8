"""Bitemporal history of changing attributes.

Observations of an entity come in any order. The ledger keeps for each field, for every stretch of
valid time, the value observed at its start and for which stretch of recorded time the ledger said so.
A late observation splits the interval it falls into, wherever that began: the earlier row is superseded
(its recorded time is closed) and its parts are recorded anew; nothing is overwritten. So for any instant and
any recorded time from the first observation on there is exactly one row of a field, and the history as
known at any earlier time can be read.

An entity may hold a third of all observations. Valid time is cut into slices, and the sweep runs over
one slice of one field of one entity at a time. Where the last interval of a slice ends depends on
later slices: on the first start in the next slice that is known at a recorded time. Those first starts, which
are few (an observation is one only if it comes before all others of its slice that were recorded earlier),
are swept per entity on their own, and handed to each slice as further events of its sweep.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Width of the slices in which one field of one entity is swept.
SLICE_US = 21_600_000_000
#: Recorded time of what was known before the observations began.
BEFORE_ALL = -(1 << 62)
OWN = ["entity", "field", "value", "valid_from_us", "valid_to_us", "recorded_from_us", "recorded_to_us"]


class _Slice:
    """The sweep over one slice of one field of one entity, in recorded order.

    ``starts`` holds the starts of the current intervals; ``rows`` maps each start to its current row
    [recorded_from, value]; ``after`` is where the last interval ends, in a later slice (None: open).
    Closed rows are handed to ``emit``.
    """

    def __init__(self, emit) -> None:
        self.starts: list[int] = []
        self.rows: dict[int, list] = {}
        self.after: int | None = None
        self.emit = emit

    def _supersede(self, i: int, recorded: int) -> None:
        """Closes the row of interval ``i`` in recorded time and records it anew; its end is about to change."""
        start = self.starts[i]
        since, value = self.rows[start]
        if since < recorded:
            self.emit(value, start, self._end(i), since, recorded)
            self.rows[start] = [recorded, value]

    def _end(self, i: int) -> int | None:
        return self.starts[i + 1] if i + 1 < len(self.starts) else self.after

    def observe(self, valid: int, recorded: int, value: str) -> None:
        i = bisect_left(self.starts, valid)
        if i < len(self.starts) and self.starts[i] == valid:
            if self.rows[valid][1] != value:
                self._supersede(i, recorded)
                self.rows[valid] = [recorded, value]
            return
        if i:
            self._supersede(i - 1, recorded)
        insort(self.starts, valid)
        self.rows[valid] = [recorded, value]

    def follow(self, after: int, recorded: int) -> None:
        """A later slice is now known to begin at ``after``."""
        if after != self.after:
            if self.starts:
                self._supersede(len(self.starts) - 1, recorded)
            self.after = after

    def close(self) -> None:
        for i, start in enumerate(self.starts):
            since, value = self.rows[start]
            self.emit(value, start, self._end(i), since, None)


def _rows_of(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    for c in columns:
        c.clear()
    return batch


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of events (entity, field, slice, recorded, valid, value, after), in order of the first four."""
    kinds = [pa.string()] * 3 + [pa.int64()] * 4
    out: list[list] = [[] for _ in OWN]
    group, state = None, None

    def emitter(entity: str, field: str):
        def emit(value, start, end, since, until) -> None:
            for column, x in zip(out, (entity, field, value, start, end, since, until)):
                column.append(x)

        return emit

    for batch in batches:
        for entity, field, part, recorded, valid, value, after in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (entity, field, part):
                if state:
                    state.close()
                group, state = (entity, field, part), _Slice(emitter(entity, field))
            if valid is None:
                state.follow(after, recorded)
            else:
                state.observe(valid, recorded, value)
        if len(out[0]) > 20_000:
            yield _rows_of(out, kinds, OWN)
    if state:
        state.close()
    yield _rows_of(out, kinds, OWN)


_SEAM = ["entity", "field", "slice", "recorded", "after"]


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the last interval of each slice ends from which recorded time on.

    Of first starts (entity, field, recorded, valid, slice, value), in order of the first three. Holds the known slices
    of one field of one entity and the first start of each.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    out: list[list] = [[] for _ in _SEAM]
    group, slices, first = None, [], {}

    def tell(*row) -> None:
        for column, x in zip(out, row):
            column.append(x)

    for batch in batches:
        for entity, field, recorded, valid, part, _ in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (entity, field):
                group, slices, first = (entity, field), [], {}
            i = bisect_left(slices, part)
            if part not in first:
                insort(slices, part)
                if i + 1 < len(slices):
                    tell(entity, field, part, recorded, first[slices[i + 1]])
            first[part] = valid
            if i:
                tell(entity, field, slices[i - 1], recorded, valid)
        if len(out[0]) > 20_000:
            yield _rows_of(out, kinds, _SEAM)
    yield _rows_of(out, kinds, _SEAM)


def ledger(
    observations: DataFrame, entity: str, valid_us: str, recorded_us: str, order: str, fields: list[str],
    slice_us: int = SLICE_US,
) -> DataFrame:
    """The bitemporal ledger of ``observations``, one set of rows for each of ``fields``.

    Columns: entity, field, value, valid_from_us, valid_to_us, recorded_from_us, recorded_to_us. Intervals are
    [from, to); ``valid_to_us`` null is open, ``recorded_to_us`` null is the row in force. At any recorded time the
    intervals of a field follow each other without gap from its first observation on. A null field was not
    reported and says nothing. At one instant the value recorded last counts; ties of recorded time go by
    ``order``, then by the value. Observations without entity, valid or recorded time are void. Repeated
    observations add nothing; an unchanged value at another instant begins an interval, as a late one may come
    between. An empty table gives no row.
    """
    names = [f"f{i}" for i in range(len(fields))]
    seen = observations.select(
        F.col(entity).cast("string").alias("entity"), F.col(valid_us).cast("bigint").alias("valid"),
        F.col(recorded_us).cast("bigint").alias("recorded"), F.col(order).cast("bigint").alias("seq"),
        *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)],
    ).dropna(subset=["entity", "valid", "recorded"])
    group = ["entity", "field", "slice"]
    # The one exchange of the observations; fields are told apart behind it, so that both uses below share it.
    seen = seen.withColumn("slice", F.floor(F.col("valid") / slice_us)).repartition("entity", "slice")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).alias("value")) for f, n in zip(fields, names)]))
    told = seen.select("entity", "slice", "recorded", "valid", "seq", each.alias("x")).select(
        "entity", "x.field", "slice", "recorded", "valid", "x.value", "seq"
    ).filter("value is not null")
    told = told.groupBy(*group, "recorded", "valid").agg(F.max(F.struct("seq", "value")).alias("x")).select(
        *group, "recorded", "valid", "x.value"
    )
    before = Window.partitionBy(*group).orderBy("recorded", "valid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = told.withColumn("_least", F.min("valid").over(before)).filter("_least is null or valid < _least")
    # The greater slice first, so that each tells where the one before it ends.
    firsts = firsts.repartition("entity", "field").sortWithinPartitions("entity", "field", "recorded", F.col("slice").desc(), F.col("valid").desc())
    # With the value, which the seams need not: else its columns would be pruned here and the exchange not shared.
    seams = firsts.select("entity", "field", "recorded", "valid", "slice", "value").mapInArrow(
        _seams, "entity string, field string, slice bigint, recorded bigint, after bigint"
    )
    none = F.lit(None)
    events = told.withColumn("after", none.cast("bigint")).unionByName(
        seams.select(*group, "recorded", none.cast("bigint").alias("valid"), none.cast("string").alias("value"), "after")
    )
    # Starts may come nearer but never go: of those told at one instant the least counts, and is told last.
    swept = events.repartition(*group).sortWithinPartitions(*group, "recorded", F.col("after").desc_nulls_first())
    schema = ", ".join(f"{c} {'string' if i < 3 else 'bigint'}" for i, c in enumerate(OWN))
    return swept.select(*group, "recorded", "valid", "value", "after").mapInArrow(_sweep, schema)


def as_known(rows: DataFrame, at_us: int | None = None) -> DataFrame:
    """The ledger rows in force at a recorded time; the current ones for None."""
    if at_us is None:
        return rows.filter(F.col("recorded_to_us").isNull())
    until = F.col("recorded_to_us")
    return rows.filter((F.col("recorded_from_us") <= at_us) & (until.isNull() | (until > at_us)))


def values_at(rows: DataFrame, valid_us: int, at_us: int | None = None) -> DataFrame:
    """The ledger rows of one instant as known at a recorded time: one for each field that had a value then."""
    until = F.col("valid_to_us")
    return as_known(rows, at_us).filter((F.col("valid_from_us") <= valid_us) & (until.isNull() | (until > valid_us)))


_FROM, _TO, _SLICE = "valid_from_us", "valid_to_us", "_slice"
_OPEN = (1 << 63) - 1


def _pieces(rows: DataFrame, fields: list[str], slice_us: int) -> DataFrame:
    """The instants at which an interval of some field begins, with the values in force and how long all of them last.

    A field's interval that began in an earlier slice is told by one summary row of that slice.
    """
    tile = lambda f: F.when(F.col("field") == f, F.struct("value", F.coalesce(_TO, F.lit(_OPEN)).alias("to")))
    sliced = rows.withColumn(_SLICE, F.floor(F.col(_FROM) / slice_us))
    last = sliced.groupBy("entity", _SLICE).agg(*[F.max_by(tile(f), F.when(F.col("field") == f, F.col(_FROM))).alias(f) for f in fields])
    earlier = Window.partitionBy("entity").orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("entity", _SLICE, *[F.last(f, ignorenulls=True).over(earlier).alias(f"_c_{f}") for f in fields])
    order = Window.partitionBy("entity", _SLICE).orderBy(_FROM)
    upto, before = (order.rangeBetween(Window.unboundedPreceding, e) for e in (Window.currentRow, -1))
    now = {f"_n_{f}": F.coalesce(F.last(tile(f), ignorenulls=True).over(upto), F.col(f"_c_{f}")) for f in fields}
    old = {f"_o_{f}": F.coalesce(F.last(tile(f), ignorenulls=True).over(before), F.col(f"_c_{f}")) for f in fields}
    filled = sliced.join(carried, ["entity", _SLICE], "left").withColumns({**now, **old})
    differs = F.lit(False)
    for f in fields:
        differs |= ~F.col(f"_n_{f}.value").eqNullSafe(F.col(f"_o_{f}.value"))
    return filled.select(
        "entity", _SLICE, _FROM, *[F.col(f"_n_{f}.value").alias(f) for f in fields],
        F.least(F.lit(_OPEN), *[F.col(f"_n_{f}.to") for f in fields]).alias(_TO), differs.alias("_begins"),
    )


def versions(rows: DataFrame, fields: list[str], at_us: int | None = None, slice_us: int = SLICE_US) -> DataFrame:
    """The history read off a ledger: entity, fields, valid_from_us, valid_to_us (null: open).

    A version begins where any field differs from the value in force just before. It lasts as long as the
    ledger's intervals of its values do: pieces of time in which no field has a new interval are put
    together, and the version ends with the last of them. Before the first known value of any field there is
    no version. An empty ledger has none.
    """
    # The sweep must not run again for each of the summaries that are taken over its rows.
    pieces = _pieces(cut(as_known(rows, at_us)), fields, slice_us)
    begun = F.max(F.when(F.col("_begins"), F.col(_FROM))).over(
        Window.partitionBy("entity", _SLICE).orderBy(_FROM).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Every slice leaves its versions and, before the first of them, a rest of one that began in an earlier slice.
    parts = pieces.withColumn("_begun", begun).groupBy("entity", _SLICE, "_begun").agg(
        *[F.max(F.when(F.col(_FROM) == F.col("_begun"), F.col(f))).alias(f) for f in fields], F.max(_TO).alias(_TO)
    )
    # Rests belong to the last version before them. Only one row of each slice decides which that is.
    late = parts.groupBy("entity", _SLICE).agg(F.max("_begun").alias("_last"), F.max(F.when(F.col("_begun").isNull(), F.col(_TO))).alias("_rest"))
    earlier = Window.partitionBy("entity").orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    rests = late.withColumn("_begun", F.last("_last", ignorenulls=True).over(earlier)).filter("_rest is not null")
    rests = rests.groupBy("entity", "_begun").agg(F.max("_rest").alias("_rest"))
    own = parts.filter("_begun is not null")
    end = F.greatest(F.col(_TO), F.col("_rest"))
    return own.join(rests, ["entity", "_begun"], "left").select(
        "entity", *fields, F.col("_begun").alias(_FROM), F.when(end < _OPEN, end).alias(_TO)
    )
