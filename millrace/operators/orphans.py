"""References to records that do not exist, directly or through orphaned parents.

``known_periods`` turns loads and removals of a table into the periods in which each of its keys
existed, ``links`` reduces the references of a table to distinct ones with their number, and ``cascade``
follows the graph of foreign keys to its fixpoint: a reference made outside every period of its key is
a direct orphan, and one that names a record which is itself an orphan on that day is an inherited one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import reference
from millrace.session import cut

LINK = ["child_table", "parent_table", "ref_value", "own_key", "day"]
KEY = ["parent_table", "ref_value"]
#: Before and after all days, counted from 1970.
FIRST, LAST = -(2**31), 2**31 - 1


@dataclass(frozen=True)
class ForeignKey:
    """``child``.``column`` names a ``parent`` record by ``key``."""

    child: str
    column: str
    parent: str
    key: str


def known_periods(loads: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Periods [since, until) in which a key is known; ``until`` null: to this day.

    ``loads`` has (ref_value, day) and ``removals`` (ref_value, day). A load counts from its day on, up to
    the first removal on that day or later; a load on the day of a removal is removed with it. Null keys
    and days count for nothing. Both are reduced to distinct days first.
    """
    both = loads.select("ref_value", "day", F.lit(0).alias("gone"))
    if removals is not None:
        both = both.unionByName(removals.select("ref_value", "day", F.lit(1).alias("gone")))
    both = both.dropna().distinct()
    ahead = Window.partitionBy("ref_value").orderBy("day", "gone").rowsBetween(0, Window.unboundedFollowing)
    removed = F.min(F.when(F.col("gone") == 1, F.col("day"))).over(ahead)
    spans = both.withColumn("until", removed).filter(F.col("gone") == 0)
    spans = spans.filter(F.col("until").isNull() | (F.col("until") > F.col("day")))
    # Loads up to the same removal make one period.
    return spans.groupBy("ref_value", "until").agg(F.min("day").alias("since"))


def links(
    df: DataFrame, child: str, graph: list[ForeignKey], day: Column, compare: Callable[[Column], Column] = reference
) -> DataFrame:
    """The distinct references of table ``child`` by LINK, with their number ``n``.

    Keys are compared by ``compare``; null of it refers to nothing, and is listed only with an
    ``own_key``, as the record takes the place of an earlier one. ``own_key`` is the key by which other
    tables of the graph name this one's records, null where none does, so that a table at the end
    of the graph is reduced to its distinct references before anything moves. Values are reduced as
    they are written first, and compared after: there are far fewer of them than rows. References
    without day are left out.
    """
    out = [e for e in graph if e.child == child]
    named = [e.key for e in graph if e.parent == child]
    own = F.col(named[0]).cast("string") if named else F.lit(None).cast("string")
    pair = [F.struct(F.lit(e.parent).alias("parent_table"), F.col(e.column).cast("string").alias("raw")) for e in out]
    raw = df.select(F.explode(F.array(*pair)).alias("r"), own.alias("own"), day.alias("day"))
    raw = raw.select("r.parent_table", "r.raw", "own", "day").filter("(raw is not null or own is not null) and day is not null")
    written = raw.groupBy("parent_table", "raw", "own", "day").agg(F.count(F.lit(1)).alias("n"))
    compared = written.select(
        F.lit(child).alias("child_table"), "parent_table", compare(F.col("raw")).alias("ref_value"),
        compare(F.col("own")).alias("own_key"), "day", "n",
    ).filter("ref_value is not null or own_key is not null")
    return compared.groupBy(*LINK).agg(F.sum("n").alias("n"))


def _between(day: Column, side: str) -> Column:
    return (F.unix_date(day) >= F.col(f"{side}.since")) & (F.unix_date(day) < F.col(f"{side}.until"))


def _records(references: DataFrame) -> DataFrame:
    """What the records of each own key refer to, from the record's day to that of the next one.

    The first record also stands for the time before it: whether its key was known then is told by the
    known periods of its table.
    """
    own = references.filter("own_key is not null").withColumn("at", F.unix_date("day"))
    days = own.select("child_table", "own_key", "at").distinct()
    in_turn = Window.partitionBy("child_table", "own_key").orderBy("at")
    spans = days.select(
        "child_table", "own_key", "at",
        F.when(F.lag("at").over(in_turn).isNull(), FIRST).otherwise(F.col("at")).alias("since"),
        F.coalesce(F.lead("at").over(in_turn), F.lit(LAST)).alias("until"),
    )
    refers = own.filter("ref_value is not null").select("child_table", "own_key", "at", *KEY).distinct()
    return refers.join(spans, ["child_table", "own_key", "at"]).drop("at")


def _unknown(named: DataFrame, known: DataFrame) -> DataFrame:
    """Periods by KEY in which the keys of ``named`` are not known."""
    periods = known.select(
        *KEY, F.coalesce(F.unix_date("since"), F.lit(FIRST)).alias("since"),
        F.coalesce(F.unix_date("until"), F.lit(LAST)).alias("until"),
    ).join(named, KEY, "left_semi")
    ends = named.select(*KEY, F.lit(LAST).alias("since"), F.lit(LAST).alias("until"))
    before = Window.partitionBy(*KEY).orderBy("since", "until").rowsBetween(Window.unboundedPreceding, -1)
    gaps = periods.unionByName(ends).withColumn("after", F.coalesce(F.max("until").over(before), F.lit(FIRST)))
    return gaps.filter("after < since").select(*KEY, F.col("after").alias("since"), F.col("since").alias("until"))


def _passed_on(records: DataFrame, periods: DataFrame) -> DataFrame:
    """Periods in which ``records`` are orphans, by the key that names them, from those of what they refer to."""
    met = records.alias("r").join(periods.alias("p"), [F.col(f"r.{c}") == F.col(f"p.{c}") for c in KEY])
    return met.select(
        F.col("r.child_table").alias("parent_table"), F.col("r.own_key").alias("ref_value"),
        F.greatest("r.since", "p.since").alias("since"), F.least("r.until", "p.until").alias("until"),
    ).filter("since < until").distinct()


def cascade(references: DataFrame, known: DataFrame) -> DataFrame:
    """Orphans per table, key and day: child_table, parent_table, ref_value, day, kind, depth, record_count.

    ``references`` are ``links`` of all tables, ``known`` has (parent_table, ref_value, since, until) of all
    parents. Depth 0 (direct) is a reference outside every period of its key; depth d (inherited) is
    made on a day on which the record it names is an orphan of depth d-1, and the least depth counts.
    A record is an orphan while what it refers to is not known, so also after its own day; it stands
    until the day of the next record of its key. Levels are made by semi-joins down the graph until
    no further period is passed on, so cycles end too.
    """
    references = cut(references)
    asked = references.filter("ref_value is not null")
    r, k = asked.alias("r"), known.alias("k")
    held = (
        (F.col("r.parent_table") == F.col("k.parent_table"))
        & (F.col("r.ref_value") == F.col("k.ref_value"))
        & (F.col("k.since").isNull() | (F.col("r.day") >= F.col("k.since")))
        & (F.col("k.until").isNull() | (F.col("r.day") < F.col("k.until")))
    )
    found = cut(r.join(k, held, "left_anti").withColumn("depth", F.lit(0)))
    depth = 0
    records = cut(_records(references))
    seen = periods = None
    while not records.isEmpty():
        depth += 1
        if periods is None:
            seen = periods = cut(_passed_on(records, _unknown(records.select(*KEY).distinct(), known)))
        else:
            further, s = _passed_on(records, periods).alias("p"), seen.alias("s")
            covered = (F.col("p.since") >= F.col("s.since")) & (F.col("p.until") <= F.col("s.until"))
            for c in KEY:
                covered &= F.col(f"p.{c}") == F.col(f"s.{c}")
            periods = cut(further.join(s, covered, "left_anti"))
            seen = seen.unionByName(periods)
        if periods.isEmpty():
            break
        gone = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in KEY]
        below = r.join(periods.alias("p"), [*gone, _between(F.col("r.day"), "p")], "left_semi").select(*references.columns)
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in LINK]
        new = below.alias("l").join(found.select(*LINK).alias("s"), same, "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(cut(new))
    return found.groupBy("child_table", "parent_table", "ref_value", "day", "depth").agg(
        F.sum("n").alias("record_count")
    ).withColumn("kind", F.when(F.col("depth") == 0, "direct").otherwise("inherited"))


def orphans(
    tables: dict[str, DataFrame], graph: list[ForeignKey], day: Column, known: DataFrame | None = None,
    compare: Callable[[Column], Column] = reference,
) -> DataFrame:
    """``cascade`` over whole tables; ``known`` defaults to the keys that the parents hold, at any time.

    ``day`` is taken over each child table. Empty tables give no orphan; an empty parent makes every
    reference to it one. Repeated rows count each.
    """
    asked = None
    for child in dict.fromkeys(e.child for e in graph):
        part = links(tables[child], child, graph, day, compare)
        asked = part if asked is None else asked.unionByName(part)
    if known is None:
        always = F.lit(None).cast("date")
        for parent, key in sorted({(e.parent, e.key) for e in graph}):
            part = tables[parent].select(F.lit(parent).alias("parent_table"), compare(F.col(key).cast("string")).alias("ref_value"))
            part = part.dropna().distinct().withColumn("since", always).withColumn("until", always)
            known = part if known is None else known.unionByName(part)
    return cascade(asked, known)
