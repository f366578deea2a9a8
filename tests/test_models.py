"""The telemetry models on small frames: one test per rule that is easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import quality
from millrace.operators import frequency, intervals, models
from millrace.operators.neighbours import with_next
from millrace.schemas import BATCH_LOG, BRONZE, RAW

T0 = dt.datetime(2026, 4, 1, 10)
at = lambda s: T0 + dt.timedelta(seconds=s)


def events(spark, rows):
    """Landing rows from dictionaries; what is not given is null or a default."""
    base = {f.name: None for f in BRONZE["bronze_device_events"]}
    base |= {"event_type_code": "STATUS_CHANGE", "machine_id": "M", "machine_type": "SLICER", "load_date": T0.date(), "event_date": T0.date(), "_loaded_at": T0}
    full = []
    for i, r in enumerate(rows):
        x = base | {"event_id": f"e{i}", "source_ingested_at": T0} | r
        full.append(tuple(x[f.name] for f in BRONZE["bronze_device_events"]))
    return spark.createDataFrame(full, BRONZE["bronze_device_events"])


def machines(spark, *ids):
    rows = [(i, "BAKER", "m", None, "Plant", "X", None, None, "u", "v1", T0 + dt.timedelta(n)) for i in ids for n in (0, 1)]
    return spark.createDataFrame(rows, BRONZE["bronze_machines"])


def types(spark, *codes):
    return spark.createDataFrame([(c, "cat", "d", True, T0) for c in codes], BRONZE["bronze_event_types"])


def fact(spark, rows):
    return models.fact_device_events(events(spark, rows), machines(spark, "M", "N"), types(spark, "STATUS_CHANGE"))


def test_quarantine_comes_before_the_choice_of_copy(spark):
    rows = [{"event_id": "a", "source_ingested_at": at(1)}, {"event_id": "a", "source_ingested_at": at(9), "machine_id": None}, {"event_id": "b", "machine_id": None}]
    assert [(r.event_id, r.source_ingested_at) for r in models.conformed_events(events(spark, rows)).collect()] == [("a", at(1))]


def test_fact_keeps_the_latest_delivery_own_type_and_unknown_codes(spark):
    rows = [
        {"event_id": "a", "status_value": "IDLE"}, {"event_id": "a", "status_value": "RUNNING", "source_ingested_at": at(5)},
        {"event_id": "b", "event_type_code": "NEW"}, {"event_id": "c", "machine_id": "unknown"},
        {"event_id": "d", "event_type_code": "CYCLE_COMPLETE", "product_count": 7, "temperature_c": 1.0},
    ]
    got = {r.event_id: r for r in fact(spark, rows).collect()}
    assert got.keys() == {"a", "b", "d"}
    assert (got["a"].status_value, got["a"].machine_type, got["a"].plant_location, got["a"].event_category) == ("RUNNING", "SLICER", "Plant", "cat")
    assert got["b"].event_category is None and got["b"].event_value is None and got["d"].event_value == 7.0


def test_replay_doubles_bronze_and_leaves_silver(spark):
    raw = events(spark, [{"event_id": str(i), "event_timestamp": at(i)} for i in range(9)]).drop("_loaded_at")
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    once = models.bronze(text, "bronze_device_events", T0)
    twice = once.unionByName(models.bronze(text, "bronze_device_events", at(60), T0.date()))
    assert (once.schema.simpleString(), twice.count()) == (BRONZE["bronze_device_events"].simpleString(), 18)
    a, b = (models.fact_device_events(x, machines(spark, "M"), types(spark)).orderBy("event_id").collect() for x in (once, twice))
    assert a == b and len(a) == 9


def test_bad_values_raise_at_the_cast(spark):
    bad = spark.createDataFrame([("x",) * len(RAW["raw_device_events"])], [f.name for f in RAW["raw_device_events"]])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        models.bronze(bad, "bronze_device_events", T0).collect()


def test_versions_of_a_machine(spark):
    rows = [{"event_id": k, "event_timestamp": at(s), "status_value": v} for k, s, v in (("c", 0, "RUNNING"), ("b", 90_000, "IDLE"), ("a", 90_000, "ERROR"), ("d", 300_000, "RUNNING"))]
    rows.append({"event_id": "n", "machine_id": "N", "event_type_code": "CYCLE_START", "event_timestamp": at(1)})
    dim = models.dim_machines(events(spark, rows), machines(spark, "M", "N"))
    got = [(r.status_value, r.valid_from, r.valid_to, r.is_current) for r in dim.orderBy("valid_from").collect()]
    assert got == [("RUNNING", at(0), at(90_000), False), ("ERROR", at(90_000), at(300_000), False), ("RUNNING", at(300_000), None, True)]
    assert quality.scd2_overlap(dim).count() == quality.one_current(dim).count() == quality.unique(dim, "machine_sk").count() == 0


def test_only_a_raise_with_its_resolution_next_is_a_fault(spark):
    order = ["RAISED", "RAISED", "RESOLVED", "RESOLVED", "RAISED"]
    rows = [{"event_type_code": f"ERROR_{k}", "error_code": "E1", "event_timestamp": at(86_400 * i)} for i, k in enumerate(order)]
    rows += [{"event_type_code": "ERROR_RAISED", "error_code": None, "event_timestamp": at(1)}, {"event_type_code": "ERROR_RESOLVED", "error_code": None, "event_timestamp": at(2)}]
    codes = spark.createDataFrame([("E1", "LOW", "d", True, T0)], BRONZE["bronze_error_codes"])
    found = models.fact_error_events(fact(spark, rows), codes).collect()
    assert [(r.raised_at, r.resolved_at, r.resolution_time_seconds) for r in found] == [(at(86_400), at(172_800), 86_400)]
    assert {r.raised_at for r in models.open_faults(fact(spark, rows)).collect()} == {at(0), at(4 * 86_400)}


def test_minute_bucket_of_the_walk_through(spark):
    reading = {"event_type_code": "SENSOR_VIBRATION_READING"}
    rows = [{"event_id": f"demo-{i}", "event_timestamp": at(5 + 15 * i), "vibration_mm_s": v, **reading} for i, v in enumerate((2.1, 4.8, 1.2, 3.3))]
    rows += [rows[1] | {"source_ingested_at": at(99)}, {"event_timestamp": at(7), "machine_id": None, **reading}]
    r = frequency.event_frequency(fact(spark, rows), "minute").collect()[0]
    assert (r.event_count, r.timestamp_of_min_value, r.timestamp_of_max_value, r.avg_seconds_between_events) == (4, at(35), at(20), 15.0)


def test_null_values_are_least_and_ties_go_to_the_earlier(spark):
    reading = {"event_type_code": "SENSOR_SPEED_READING"}
    rows = [{"event_timestamp": at(s), "speed_units_per_min": v, **reading} for s, v in ((1, 5.0), (2, None), (3, 5.0), (4, None))]
    rows += [{"event_timestamp": at(s), "event_type_code": "HEARTBEAT"} for s in (9, 6, 7)]
    got = {r.event_type_code: r for r in frequency.event_frequency(fact(spark, rows), "day").collect()}
    assert (got["SENSOR_SPEED_READING"].timestamp_of_min_value, got["SENSOR_SPEED_READING"].timestamp_of_max_value) == (at(2), at(1))
    assert (got["HEARTBEAT"].timestamp_of_min_value, got["HEARTBEAT"].timestamp_of_max_value) == (at(6), at(6))


def test_watermark_hides_late_events_and_the_first_gap(spark):
    rows = [{"event_timestamp": at(60 * s)} for s in range(6)]
    all_events = fact(spark, rows)
    marks = models.seed_watermark(machines(spark, "M", "N"), types(spark, "STATUS_CHANGE"))
    first = frequency.event_frequency(all_events.filter(F.col("event_timestamp") < at(150)), "hour", marks)
    moved = frequency.advance(marks, first)
    assert {r.machine_id: r[frequency.MARK] for r in moved.collect()} == {"M": at(120), "N": dt.datetime(1900, 1, 1)}
    late = fact(spark, [*rows, {"event_timestamp": at(61)}])
    second = frequency.event_frequency(late, "hour", moved).collect()
    assert [(r.event_count, r.avg_seconds_between_events) for r in second] == [(3, 60.0)]
    assert frequency.late(late, moved).count() == 4
    assert frequency.event_frequency(all_events, "hour", frequency.advance(moved, frequency.event_frequency(late, "hour", moved))).count() == 0


def test_coarser_grains_merge_exactly(spark):
    rows = [{"event_timestamp": at(s * 997), "product_count": s % 7, "event_type_code": "PRODUCT_COUNT_UPDATE"} for s in range(300)]
    f = fact(spark, rows)
    rolled = frequency.finish(frequency.coarser(frequency.coarser(frequency.partials(f, "minute"), "hour"), "day"))
    direct = frequency.event_frequency(f, "day")
    assert rolled.orderBy("bucket_start").collect() == direct.orderBy("bucket_start").collect()


def test_seeding_keeps_progress(spark):
    m, t = machines(spark, "M", "N"), types(spark, "A", "B")
    state = models.seed_watermark(m, t).filter("machine_id = 'M'")
    assert {(r.machine_id, r.event_type_code) for r in models.seed_watermark(m, t, state).collect()} == {("N", "A"), ("N", "B")}
    assert {r.kpi_code for r in models.seed_kpi_mapping(m, t).collect()} == {"all"}


def test_uptime_splits_at_midnight_and_parts_add_up(spark):
    rows = [{"event_timestamp": at(0), "status_value": "RUNNING"}, {"event_timestamp": dt.datetime(2026, 4, 2, 6), "status_value": "IDLE"}, {"event_timestamp": dt.datetime(2026, 4, 3), "status_value": "STOPPED"}]
    dim = models.dim_machines(events(spark, rows), machines(spark, "M"))
    got = {r.event_date.day: r for r in models.uptime_daily(dim, dt.datetime(2026, 4, 3, 12)).collect()}
    assert got.keys() == {1, 2, 3}
    assert (got[1].total_seconds, got[1].running_seconds, got[1].pct_running) == (50_400, 50_400, 100.0)
    assert (got[2].running_seconds, got[2].idle_seconds, got[2].pct_running) == (21_600, 64_800, 25.0)
    assert (got[3].total_seconds, got[3].down_seconds) == (43_200, 43_200)


def test_reports(spark):
    reading = {"event_type_code": "SENSOR_TEMPERATURE_READING"}
    rows = [
        {"event_timestamp": at(0), "status_value": "IDLE"}, {"event_timestamp": at(1), "temperature_c": 4.0, **reading},
        {"event_timestamp": at(2), "temperature_c": None, **reading}, {"event_timestamp": at(3), "event_type_code": "CYCLE_COMPLETE", "product_count": 3, "cycle_duration_seconds": 10},
    ]
    f, dim = fact(spark, rows), models.dim_machines(events(spark, rows), machines(spark, "M", "N"))
    perf = models.type_performance(f).collect()[0]
    assert (perf.avg_temperature_c, perf.temperature_reading_count, perf.speed_reading_count) == (4.0, 2, 0)
    out = models.production_output(f).collect()[0]
    assert (out.total_product_count, out.cycle_complete_count, out.cycle_product_count, out.avg_cycle_duration_seconds) == (0, 1, 3, 10.0)
    now = models.machine_status(dim, f).collect()
    assert [(r.status_value, r.latest_temperature_c, r.latest_temperature_at, r.latest_speed_at) for r in now] == [("IDLE", None, at(2), None)]


def test_as_of_join_at_the_edges(spark):
    v = spark.createDataFrame([("M", "A", at(0), at(100_000)), ("M", "B", at(100_000), None)], "machine_id string, s string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    f = spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate([("M", at(-1)), ("M", at(0)), ("M", at(99_999)), ("M", at(100_000)), ("M", at(900_000)), ("N", at(1)), (None, at(1)), ("M", None)])], "i int, machine_id string, ts timestamp_ntz")
    got = {r.i: r.s for r in intervals.as_of(f, v, ["machine_id"], "ts", "valid_from", "valid_to").collect()}
    assert got == {0: None, 1: "A", 2: "A", 3: "B", 4: "B", 5: None, 6: None, 7: None}


def test_as_of_status_keeps_events_with_wrong_clocks(spark, tmp_path):
    from millrace.plans import fleet

    seen, far = at(500), at(0).replace(year=9999, month=12, day=31)
    instants = {"right": at(100), "before": at(-90_000), "long ago": at(0).replace(year=2000), "after seen": at(900_000), "far": far, "null": None}
    rows = [(i, "M", t, at(0).date(), seen) for i, t in instants.items()] + [("no key", None, at(100), None, None), ("not seen", "M", at(200), None, None)]
    spark.createDataFrame(
        rows, "event_id string, machine_id string, event_timestamp timestamp_ntz, load_date date, source_ingested_at timestamp_ntz"
    ).write.parquet(str(tmp_path / "bronze_device_events.parquet"))
    spark.createDataFrame(
        [("M", "A", "1", at(0), at(1000)), ("M", "B", "1", at(1000), None)],
        "machine_id string, status_value string, firmware_version string, valid_from timestamp_ntz, valid_to timestamp_ntz",
    ).write.parquet(str(tmp_path / "silver_dim_machines.parquet"))
    got = sorted((r.event_id, r.status_value or "") for r in fleet.as_of_status(spark, str(tmp_path)).collect())
    assert got == [("after seen", "B"), ("before", ""), ("far", "B"), ("long ago", ""), ("no key", ""), ("not seen", "A"), ("null", ""), ("right", "A")]


def test_next_row_across_slices_with_nulls(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(400_000), 2), ("a", at(400_000), 3), ("a", None, 0), (None, at(1), 9), (None, at(200_000), 8)], "k string, ts timestamp_ntz, n int")
    got = {r.n: r.nx for r in with_next(df, ["k"], "ts", ["n"], {"nx": "n"}).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: None, 9: 8, 8: None}


def test_batch_log(spark):
    out = frequency.event_frequency(fact(spark, [{"event_timestamp": at(0)}, {"event_timestamp": at(90_000)}]), "day")
    row = models.batch_log_row(out, "r", "m", T0, at(61)).collect()[0]
    assert (row.row_count, row.distinct_machine_count, row.distinct_event_count, row.duration_seconds) == (2, 1, 1, 61)
    assert models.empty_batch_log(out).schema == BATCH_LOG
