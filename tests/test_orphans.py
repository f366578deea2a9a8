import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import orphans
from millrace.operators.orphans import ForeignKey

D = lambda n: dt.date(2020, 1, n)


def test_known_periods(spark):
    loads = spark.createDataFrame(
        [("a", D(2)), ("a", D(2)), ("a", D(4)), ("b", D(3)), ("c", D(5)), (None, D(1)), ("d", None)], "ref_value string, day date"
    )
    gone = spark.createDataFrame([("a", D(6)), ("b", D(3)), ("c", D(2)), ("x", D(1)), ("c", D(8)), ("c", D(8))], "ref_value string, day date")
    got = {(r.ref_value, r.since, r.until) for r in orphans.known_periods(loads, gone).collect()}
    assert got == {("a", D(2), D(6)), ("c", D(5), D(8))}
    empty = spark.createDataFrame([], "ref_value string, day date")
    assert {tuple(r) for r in orphans.known_periods(loads.filter("ref_value = 'a'"), empty).select("ref_value", "since", "until").collect()} == {("a", D(2), None)}


def test_direct_orphans_by_day_and_writing(spark):
    known = spark.createDataFrame(
        [("t", "A", D(2), D(4)), ("t", "A", D(6), None), ("u", "B", None, None)], "parent_table string, ref_value string, since date, until date"
    )
    rows = [("a", "b", D(d), "x") for d in (1, 2, 3, 4, 5, 6, 9, 9)] + [(" A ", None, D(1), None), ("b", " ", D(3), None), (None, "b", D(1), None), ("z", "z", None, None)]
    table = spark.createDataFrame(rows, "t string, u string, day date, ref_value string")
    graph = [ForeignKey("c", "t", "t", "k"), ForeignKey("c", "u", "u", "k")]
    got = {(r.parent_table, r.ref_value, r.day.day, r.record_count) for r in orphans.orphans({"c": table}, graph, F.col("day"), known).collect()}
    assert got == {("t", "A", 1, 2), ("t", "A", 4, 1), ("t", "A", 5, 1), ("t", "B", 3, 1)}


def test_cascade_direct_and_inherited_with_cycle(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    records = {
        "root": make([("r1",), (None,)], "id string"),
        "mid": make([("m1", "r1", D(1)), ("m2", "gone", D(1)), ("m3", None, D(1)), ("m2", "gone", D(1))], "id string, root string, day date"),
        "leaf": make([("l1", "m1", D(2)), ("l2", "m2", D(2)), ("l3", "none", D(3)), ("l4", None, D(3))], "id string, mid string, day date"),
        "tip": make([("l2", D(4)), ("l1", D(4)), ("l3", D(4)), ("l3", D(4))], "leaf string, day date"),
        "ring": make([("x", "y", D(1)), ("y", "x", D(1))], "id string, next string, day date"),
    }
    graph = [
        ForeignKey("mid", "root", "root", "id"), ForeignKey("leaf", "mid", "mid", "id"), ForeignKey("tip", "leaf", "leaf", "id"),
        ForeignKey("ring", "next", "ring", "id"),
    ]
    got = {(r.child_table, r.ref_value, r.kind, r.depth, r.record_count) for r in orphans.orphans(records, graph, F.col("day"), compare=lambda c: c).collect()}
    assert got == {
        ("mid", "gone", "direct", 0, 2), ("leaf", "m2", "inherited", 1, 1), ("leaf", "none", "direct", 0, 1),
        ("tip", "l2", "inherited", 2, 1), ("tip", "l3", "inherited", 1, 2),
    }


def test_cascade_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, root string, day date")
    graph = [ForeignKey("mid", "root", "top", "id")]
    assert orphans.orphans({"mid": empty, "top": empty}, graph, F.col("day")).count() == 0
    some = spark.createDataFrame([("1", "x", D(1))], "id string, root string, day date")
    assert [r.ref_value for r in orphans.orphans({"mid": some, "top": empty}, graph, F.col("day")).collect()] == ["X"]


def test_orphaned_for_a_time(spark):
    """A parent is an orphan while what it names is unknown; its next record takes its place."""
    known = spark.createDataFrame(
        [("root", "A", D(1), D(4)), ("root", "B", D(3), None), ("mid", "M1", D(2), None), ("mid", "M2", None, None), ("mid", "M3", D(2), None)],
        "parent_table string, ref_value string, since date, until date",
    )
    mid = [("m1", "a", D(2)), ("m1", "b", D(6)), ("m2", "c", D(2)), ("m2", None, D(5)), ("m3", "b", D(2))]
    leaf = [(f"l{m}", m, D(d)) for m in ("m1", "m2", "m3") for d in (1, 2, 3, 4, 5, 6, 7)]
    records = {
        "mid": spark.createDataFrame(mid, "id string, root string, day date"),
        "leaf": spark.createDataFrame(leaf, "id string, mid string, day date"),
        "tip": spark.createDataFrame([("lm1", D(3)), ("lm1", D(5)), ("lm1", D(7))], "leaf string, day date"),
    }
    known = known.unionByName(known.filter("ref_value = 'M2'").selectExpr("'leaf' parent_table", "'LM1' ref_value", "since", "until"))
    graph = [ForeignKey("mid", "root", "root", "id"), ForeignKey("leaf", "mid", "mid", "id"), ForeignKey("tip", "leaf", "leaf", "id")]
    got = {(r.child_table, r.ref_value, r.day.day, r.depth, r.record_count) for r in orphans.orphans(records, graph, F.col("day"), known).collect()}
    assert got == {
        ("mid", "C", 2, 0, 1), ("mid", "B", 2, 0, 1),
        ("leaf", "M1", 1, 0, 1), ("leaf", "M1", 4, 1, 1), ("leaf", "M1", 5, 1, 1),
        *[("leaf", "M2", d, 1, 1) for d in (1, 2, 3, 4)],
        ("leaf", "M3", 1, 0, 1), ("leaf", "M3", 2, 1, 1),
        ("tip", "LM1", 5, 2, 1),
    }


def test_cascade_query_knows_removals_and_late_loads(spark, tmp_path):
    from millrace.plans import preparation

    T = lambda n: dt.datetime(2020, 1, n, 12)
    tables = {
        "master_removals": ([("bronze_machines", "m1", D(5))], "ref_table string, ref_key string, removed_on date"),
        "bronze_machines": ([("M1", T(1)), ("M2", T(4))], "machine_id string, _loaded_at timestamp_ntz"),
        "bronze_error_codes": ([("E1", T(3))], "error_code string, _loaded_at timestamp_ntz"),
        "bronze_event_types": ([("T1", T(1))], "event_type_code string, _loaded_at timestamp_ntz"),
        "silver_dim_machines": ([("M1", T(2)), ("M2", T(3))], "machine_id string, valid_from timestamp_ntz"),
        "machine_snapshots": ([("M1", T(4)), ("M1", T(5)), ("M2", T(2))], "machine_id string, received_at timestamp_ntz"),
        "bronze_device_events": (
            [("M1", "E1", "T1", D(2)), ("M1", None, "T1", D(6)), ("M2", "E1", "T2", D(3)), ("M2", None, "T1", D(4))],
            "machine_id string, error_code string, event_type_code string, load_date date",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.child_table, r.ref_value, r.period.day, r.kind) for r in preparation.p5_cascade(spark, str(tmp_path)).collect()}
    events = "bronze_device_events"
    assert got == {
        ("silver_dim_machines", "M2", 3, "direct"), ("machine_snapshots", "M2", 2, "direct"), ("machine_snapshots", "M1", 5, "inherited"),
        (events, "E1", 2, "direct"), (events, "T2", 3, "direct"), (events, "M1", 6, "inherited"), (events, "M2", 3, "inherited"),
    }
