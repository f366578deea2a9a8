"""Data-quality checks: each is a query whose rows are failures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values, null aside, that occur more than once."""
    return unique_combination(df.filter(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: list, where: Column | None = None) -> DataFrame:
    """Rows with another value; null passes."""
    df = df if where is None else df.filter(where)
    return df.filter(~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Rows whose value, null aside, the parent does not hold."""
    keys = parent.select(F.col(field).alias("_parent")).dropna().distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def between(df: DataFrame, column: str, low=None, high=None, where: Column | None = None) -> DataFrame:
    """Rows outside [low, high]; an absent bound is open and null passes."""
    df = df if where is None else df.filter(where)
    return df.filter(_outside(column, low, high))


def _outside(column: str, low, high) -> Column:
    outside = F.lit(False)
    if low is not None:
        outside |= F.col(column) < low
    if high is not None:
        outside |= F.col(column) > high
    return outside


def scd2_overlap(dim: DataFrame, key: str = "machine_id") -> DataFrame:
    """Versions that begin before an earlier one of the same key ends.

    Against the greatest end so far, in order of begin, which finds every overlap without a self-join.
    """
    order = Window.partitionBy(key).orderBy("valid_from", "machine_sk").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.col("valid_to"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    return dim.withColumn("_ended", F.max(end).over(order)).filter(F.col("valid_from") < F.col("_ended")).drop("_ended")


def one_current(dim: DataFrame, key: str = "machine_id") -> DataFrame:
    """Keys with no or several current versions."""
    current = F.count(F.when(F.col("is_current"), 1)).alias("current_versions")
    return dim.groupBy(key).agg(current).filter("current_versions <> 1")


def lost_events(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Sound identifiers of the landing table that the fact does not hold."""
    kept = bronze.filter("machine_id is not null").select("event_id").distinct()
    return kept.join(silver.select("event_id"), "event_id", "left_anti")


def older_copy_kept(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Facts that are not the latest delivery of their event."""
    newest = bronze.filter("machine_id is not null").groupBy("event_id").agg(F.max("source_ingested_at").alias("_newest"))
    return silver.join(newest, "event_id").filter(F.col("source_ingested_at") != F.col("_newest")).drop("_newest")


def gap_missing(frequency: DataFrame) -> DataFrame:
    """Buckets of several events without a mean gap."""
    return frequency.filter("avg_seconds_between_events is null and event_count > 1")


def metrics(df: DataFrame, duplicate_of: str, missing_in: str) -> DataFrame:
    """row_count, duplicate_count and missing_count in one row."""
    per_value = df.groupBy(duplicate_of).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(missing_in).isNull(), 1)).alias("m")
    )
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.when((F.col("n") > 1) & F.col(duplicate_of).isNotNull(), 1)).alias("duplicate_count"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("missing_count"),
    )


def tally(df: DataFrame, verdicts: dict[str, Column]) -> DataFrame:
    """check_name and failures: for each verdict the number of rows for which it holds, all in one pass."""
    counted = df.agg(*[F.count(F.when(v, 1)).alias(f"n{i}") for i, v in enumerate(verdicts.values())])
    rows = [F.struct(F.lit(name).alias("check_name"), F.col(f"n{i}").alias("failures")) for i, name in enumerate(verdicts)]
    return counted.select(F.explode(F.array(*rows)).alias("x")).select("x.check_name", "x.failures")


def with_parents(df: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``df`` with ``_lost_<column>`` for each column that refers to a field of a parent: it is given and the parent lacks it.

    As ``relationships``, for several columns in one pass over ``df``.
    """
    for column, (parent, field) in references.items():
        keys = parent.select(F.col(field).alias("_parent")).dropna().distinct()
        met = df.join(keys, F.col(column) == F.col("_parent"), "left")
        df = met.withColumn(f"_lost_{column}", F.col(column).isNotNull() & F.col("_parent").isNull()).drop("_parent")
    return df


def copies(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """One row per identifier of the landing table: its copies ``n``, sound ones, the latest of those, and the fact's instant."""
    sound = F.col("machine_id").isNotNull()
    per_id = bronze.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(sound, 1)).alias("n_sound"),
        F.max(F.when(sound, F.col("source_ingested_at"))).alias("newest"),
    )
    return per_id.join(silver.select("event_id", F.col("source_ingested_at").alias("kept")), "event_id", "left")


def history_of(dim: DataFrame, key: str = "machine_id") -> DataFrame:
    """One row per key of a history: overlapping versions (as ``scd2_overlap``) and current ones, from one window."""
    order = Window.partitionBy(key).orderBy("valid_from", "machine_sk").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.col("valid_to"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    marked = dim.withColumn("_ended", F.max(end).over(order))
    return marked.groupBy(key).agg(
        F.count(F.when(F.col("valid_from") < F.col("_ended"), 1)).alias("n_overlap"), F.count(F.when(F.col("is_current"), 1)).alias("n_current")
    )


@dataclass(frozen=True)
class Check:
    """A named query on a table whose rows are failures.

    ``failures`` makes that query from all tables; instead, ``verdict`` may give a condition on single rows of
    the table that fail. Conditions on one table are counted together in one pass.
    """

    name: str
    table: str
    failures: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    verdict: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Result:
    name: str
    table: str
    failures: int
    error: str | None = None

    @property
    def passed(self) -> bool:
        return self.error is None and self.failures == 0


def run(checks: list[Check], tables: dict[str, DataFrame]) -> list[Result]:
    """Runs all checks, in their order; an error in one does not stop the others."""
    found: dict[Check, Result] = {}
    for name in dict.fromkeys(c.table for c in checks):
        rows = [c for c in checks if c.table == name and c.verdict]
        if not rows:
            continue
        try:
            counted = tables[name].agg(*[F.count(F.when(c.verdict(), 1)).alias(f"n{i}") for i, c in enumerate(rows)]).first()
            found |= {c: Result(c.name, name, counted[i]) for i, c in enumerate(rows)}
        except Exception as error:  # one bad column must not hide the others: they are counted one by one below
            if len(rows) == 1:
                found[rows[0]] = Result(rows[0].name, name, 0, str(error)[:500])
    for c in checks:
        if c in found:
            continue
        try:
            failing = tables[c.table].filter(c.verdict()) if c.verdict else c.failures(tables)
            found[c] = Result(c.name, c.table, failing.count())
        except Exception as error:  # the report carries it
            found[c] = Result(c.name, c.table, 0, str(error)[:500])
    return [found[c] for c in checks]


def exit_code(results: list[Result]) -> int:
    """0 if all passed, 1 if any failed or broke off."""
    return int(not all(r.passed for r in results))


def parse(table: str, spec: dict) -> list[Check]:
    """Checks from a declaration such as ``{"not_null": ["a"], "unique": ["a"], "between": [("a", 0, 100)]}``.

    Kinds: not_null, unique, accepted_values (column, values), relationships (column, table, field),
    unique_combination (lists of columns), between (column, low, high), min_rows (number), and singular
    (functions of the table that give the failing rows).
    """
    out = []
    add = lambda name, f: out.append(Check(f"{table}: {name}", table, f))
    row = lambda name, f: out.append(Check(f"{table}: {name}", table, verdict=f))
    for c in spec.get("not_null", []):
        row(f"not_null {c}", lambda c=c: F.col(c).isNull())
    for c, values in spec.get("accepted_values", []):
        row(f"accepted_values {c}", lambda c=c, v=values: ~F.col(c).isin(*v))
    for c, low, high in spec.get("between", []):
        row(f"between {c}", lambda c=c, lo=low, hi=high: _outside(c, lo, hi))
    for c in spec.get("unique", []):
        add(f"unique {c}", lambda t, c=c: unique(t[table], c))
    for c, parent, field in spec.get("relationships", []):
        add(f"relationships {c}", lambda t, c=c, p=parent, f=field: relationships(t[table], c, t[p], f))
    for columns in spec.get("unique_combination", []):
        add(f"unique_combination {','.join(columns)}", lambda t, c=columns: unique_combination(t[table], c))
    if "min_rows" in spec:
        least = spec["min_rows"]
        add("min_rows", lambda t: t[table].agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least))
    for f in spec.get("singular", []):
        add(f.__name__, lambda t, f=f: f(t[table]))
    return out
