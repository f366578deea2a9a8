"""The bitemporal ledger against a plain reading of its observations."""

import random

import pytest

from millrace.operators import history

SCHEMA = "m string, v bigint, r bigint, s bigint, a string, b string, slice string"
FIELDS = ["a", "b"]


def brute(rows, at=None):
    """Versions by definition: per instant and field the value received last, carried forward."""
    out = []
    for m in {r[0] for r in rows if r[0] is not None}:
        told = [r for r in rows if r[0] == m and r[1] is not None and r[2] is not None and (at is None or r[2] <= at)]
        now, begun = (None, None), []
        for v in sorted({r[1] for r in told}):
            new = list(now)
            for k in (0, 1):
                seen = [r for r in told if r[1] == v and r[4 + k] is not None]
                if seen:
                    new[k] = max(seen, key=lambda r: (r[2], r[3]))[4 + k]
            if tuple(new) != now:
                begun.append((v, *new))
                now = tuple(new)
        ends = [b[0] for b in begun[1:]] + [None]
        out += [(m, a, b, v, e) for (v, a, b), e in zip(begun, ends)]
    return sorted(out, key=str)


def made(spark, rows, slice_us=10):
    return history.ledger(spark.createDataFrame(rows, SCHEMA), "m", "v", "r", "s", FIELDS, slice_us)


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for s in range(n):
        m = "hot" if rnd.random() < 0.6 else rnd.choice(["x", "y", None])
        v = rnd.randrange(60)
        rows.append((m, v, v + rnd.choice([0, 1, 2, 30, 80]), s, rnd.choice([None, "A", "B"]), rnd.choice([None, "1", "2", "3"]), "clash"))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_equal_definition_now_and_then(spark, seed):
    rows = random_rows(seed)
    ledger = made(spark, rows).cache()
    for at in (None, 25, 60):
        assert read(history.versions(ledger, FIELDS, at, 10)) == brute(rows, at)
    # Slices are no part of the result.
    assert read(made(spark, rows, 1)) == read(made(spark, rows, 1000)) == read(ledger)
    assert read(history.versions(ledger, FIELDS, None, 3)) == brute(rows)


def held(rows, m, k, valid, at):
    """The value by definition: of the last start at or before ``valid`` the one received last up to ``at``."""
    told = [r for r in rows if r[0] == m and r[1] is not None and r[2] <= at and r[1] <= valid and r[4 + k] is not None]
    return max(told, key=lambda r: (r[1], r[2], r[3]))[4 + k] if told else None


@pytest.mark.parametrize("seed", [3, 4])
def test_every_instant_has_one_row_at_any_recorded_time(spark, seed):
    rows = random_rows(seed)
    ledger = [r.asDict() for r in made(spark, rows).collect()]
    inside = lambda a, b, x: a <= x and (b is None or x < b)
    for r in ledger:
        assert inside(r["valid_from_us"], r["valid_to_us"], r["valid_from_us"]) and inside(r["recorded_from_us"], r["recorded_to_us"], r["recorded_from_us"])
    for m in ("hot", "x", "y"):
        for k, field in enumerate(FIELDS):
            own = [r for r in ledger if (r["entity"], r["field"]) == (m, field)]
            for valid in range(-1, 75, 2):
                for at in range(-1, 150, 3):
                    got = [r["value"] for r in own if inside(r["valid_from_us"], r["valid_to_us"], valid) and inside(r["recorded_from_us"], r["recorded_to_us"], at)]
                    want = held(rows, m, k, valid, at)
                    assert got == ([] if want is None else [want])
    df = made(spark, rows)
    assert {(r.entity, r.field): r.value for r in history.values_at(df, 33, 50).collect()} == {
        (m, f): x for m in ("hot", "x", "y") for k, f in enumerate(FIELDS) if (x := held(rows, m, k, 33, 50)) is not None
    }


def test_late_update_splits_an_interval_of_an_earlier_slice(spark):
    rows = [("m", 1, 1, 1, "A", None, ""), ("m", 98, 98, 2, "B", None, ""), ("m", 44, 99, 3, "C", None, ""), ("m", 42, 100, 4, "C", None, "")]
    got = {(r.value, r.valid_from_us, r.valid_to_us, r.recorded_from_us, r.recorded_to_us) for r in made(spark, rows).collect()}
    assert got == {
        ("A", 1, None, 1, 98), ("A", 1, 98, 98, 99), ("A", 1, 44, 99, 100), ("A", 1, 42, 100, None),
        ("C", 44, 98, 99, None), ("C", 42, 44, 100, None), ("B", 98, None, 98, None),
    }
    assert read(history.versions(made(spark, rows), FIELDS, None, 10)) == [("m", "A", None, 1, 42), ("m", "B", None, 98, None), ("m", "C", None, 42, 98)]


def test_correction_at_one_instant_supersedes(spark):
    rows = [("m", 5, 5, 1, "A", "1", ""), ("m", 5, 9, 2, "B", None, ""), ("m", 5, 9, 3, "A", "1", ""), ("m", 5, 12, 4, "B", "1", "")]
    got = {(r.field, r.value, r.recorded_from_us, r.recorded_to_us) for r in made(spark, rows).collect()}
    assert got == {("a", "A", 5, 12), ("a", "B", 12, None), ("b", "1", 5, None)}


def test_void_rows_and_empty_table(spark):
    rows = [(None, 1, 1, 1, "A", "1", ""), ("m", None, 1, 2, "A", "1", ""), ("m", 1, None, 3, "A", "1", ""), ("m", 2, 2, 4, None, None, "")]
    assert read(history.versions(made(spark, rows), FIELDS)) == []
    assert read(history.versions(made(spark, []), FIELDS)) == []
    assert read(made(spark, rows)) == []


def test_fields_may_bear_the_names_of_the_ledger(spark):
    df = spark.createDataFrame([("m", 1, 1, 1, "A", "x")], "m string, v bigint, r bigint, s bigint, slice string, value string")
    rows = history.ledger(df, "m", "v", "r", "s", ["slice", "value"])
    assert read(rows.select("field", "value")) == [("slice", "A"), ("value", "x")]
    assert [tuple(r) for r in history.versions(rows, ["slice", "value"]).collect()] == [("m", "A", "x", 1, None)]
