import datetime as dt
import uuid

from pyspark.sql import functions as F

from millrace.functions.keys import dashed, hex_identity
from millrace.operators import delivery

SCHEMA = "event_id string, n bigint, extra string, _msg_id string"


def kept(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return delivery.exactly_once(df, hex_identity(F.col("event_id")), [F.col("n").desc(), F.col("extra")])


def test_one_of_each_and_the_best(spark):
    ids = [str(uuid.UUID(int=i * 7919)) for i in range(200)]
    hot = ids[0]
    rows = [(i, 1, "a", "z") for i in ids]
    rows += [(f"urn:uuid:{i.upper()}", 5, "b", None) for i in ids[:40]] + [("{" + i + "}", 5, "a", None) for i in ids[:10]]
    rows += [(hot.replace("-", ""), 2, "h", None)] * 300
    got = {r["_msg_id"]: r for r in kept(spark, rows).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        r = got[i.replace("-", "")]
        assert (r.n, r.extra) == ((5, "a") if k < 10 else (5, "b") if k < 40 else (1, "a"))
        assert r["_msg_copies"] == (303 if k == 0 else 3 if k < 10 else 2 if k < 40 else 1)


def test_one_identifier_with_a_third_of_all_rows_moves_one_row_a_task(spark):
    rows = spark.range(0, 30_000, 1, 6).selectExpr(
        "if(id % 3 = 0, repeat('a', 32), lpad(hex(id), 32, '0')) event_id", "id n", "'' extra", "'' _msg_id"
    )
    out = delivery.exactly_once(rows, hex_identity(F.col("event_id")), [F.col("n").desc()])
    got = {r["_msg_id"]: (r.n, r["_msg_copies"]) for r in out.collect()}
    assert len(got) == 20_001 and got["a" * 32] == (29_997, 10_000)
    assert all(copies == 1 for k, (_, copies) in got.items() if k != "a" * 32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    # Full rows meet in one exchange only, behind the cut of each task.
    assert final.count("WindowGroupLimit") == 2 and "Partial" in final


def test_singletons_that_share_a_bit_are_singletons(spark, monkeypatch):
    monkeypatch.setattr(delivery, "BUCKETS", 1)
    monkeypatch.setattr(delivery, "BUCKET_BITS", 8)
    rows = [(f"{i:032x}", 1, "x", None) for i in range(300)] + [(f"{i:032x}", 2, "y", None) for i in range(20)] + [(None, 1, "z", None)] * 4
    got = [(r["_msg_id"], r.n, r["_msg_copies"]) for r in kept(spark, rows).collect()]
    want = [(f"{i:032x}", 2 if i < 20 else 1, 2 if i < 20 else 1) for i in range(300)] + [(None, 1, 1)] * 4
    assert sorted(got, key=str) == sorted(want, key=str)
    df = spark.createDataFrame(rows, SCHEMA)
    assert delivery.ranked_repeats(df, hex_identity(F.col("event_id")), [F.col("n")]).count() == 20


def test_rows_without_identifier_all_stay(spark):
    rows = [(None, 1, None, None)] * 3 + [("", 1, None, None), (" ", 1, None, None), ("short", None, None, None), ("SHORT ", 2, None, None)]
    got = sorted((r["_msg_id"] or "", r["_msg_copies"], r.n or 0) for r in kept(spark, rows).collect())
    assert got == [("", 1, 1)] * 5 + [("short", 2, 2)]


def test_ties_repeated_rows_and_empty(spark):
    assert [tuple(r)[:3] for r in kept(spark, [("a" * 32, 1, "x", "")] * 5).collect()] == [("a" * 32, 1, "x")]
    assert kept(spark, []).count() == 0
    df = spark.createDataFrame([("a" * 32, 1, "x", "")], SCHEMA)
    assert delivery.ranked_repeats(df, hex_identity(F.col("event_id")), [F.col("n")]).count() == 0


def test_new_messages_meet_stored_ones(spark):
    stored = spark.createDataFrame([("b" * 32, 1, "old", ""), ("c" * 32, 9, "old", "")], SCHEMA)
    new = spark.createDataFrame([("B" * 32, 2, "new", ""), ("c" * 32, 3, "new", ""), ("d" * 32, 1, "new", "")], SCHEMA)
    out = delivery.exactly_once_incremental(stored, new, hex_identity(F.col("event_id")), [F.col("n").desc()])
    assert {r["_msg_id"][0]: r.extra for r in out.collect()} == {"b": "new", "c": "old", "d": "new"}


def test_identity_forms(spark):
    want = "0a1b2c3d-0000-4000-8000-00000000abcd"
    forms = [want, want.upper(), want.replace("-", ""), f"urn:uuid:{want}", "{" + want + "}", f" {want} ", f"evt_{want}", f"id:{want.upper()}"]
    df = spark.createDataFrame([(f,) for f in forms], "e string")
    assert {r[0] for r in df.select(dashed(hex_identity(F.col("e")))).collect()} == {want}


def test_exactly_once_query_gives_whole_rows(spark, tmp_path):
    from millrace.plans import preparation

    seen = dt.datetime(2020, 1, 1, 12)
    rows = [(i, "M1", kind, "T", seen, seen.date(), seen) for i, kind in (("0" * 32, "SLICER"), ("0" * 32, "BAKER"), ("1" * 32, "PACKER"))]
    schema = "event_id string, machine_id string, machine_type string, event_type_code string, source_ingested_at timestamp_ntz, load_date date, _loaded_at timestamp_ntz"
    events = spark.createDataFrame(rows, schema)
    events.write.parquet(str(tmp_path / "bronze_device_events.parquet"))
    got = preparation.p4_exactly_once(spark, str(tmp_path))
    assert got.columns == ["message_id", "copies", *events.columns]
    assert sorted((r.copies, r.machine_type) for r in got.collect()) == [(1, "PACKER"), (2, "BAKER")]
