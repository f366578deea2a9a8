"""Selection, running, state, checks, sources and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace import quality
from millrace.plans import pipeline
from millrace.plans.pipeline import Context, Registry, run, telemetry
from millrace.schemas import BRONZE, RAW, WATERMARK
from millrace.sources import files
from millrace.sources.state import StaleVersion, StateTable, delete, update, upsert
from millrace.streaming import telemetry as streams
from tests.test_models import T0, at, events


def raw(spark, load=T0.date(), n=12):
    rows = [
        {"event_id": f"{load}-{i}", "event_timestamp": at(86_400 * (load - T0.date()).days + 60 * i), "load_date": load,
         "status_value": "RUNNING", "event_type_code": "STATUS_CHANGE" if i % 2 else "CYCLE_START", "machine_id": "M1"}
        for i in range(n)
    ]
    return {
        "raw_device_events": events(spark, rows).drop("_loaded_at"),
        "raw_machines": spark.createDataFrame([("M1", "SLICER", "m", None, "p", "c", None, None, "u", "v1")], RAW["raw_machines"]),
        "raw_event_types": spark.createDataFrame([(c, "lifecycle", "d", False) for c in ("STATUS_CHANGE", "CYCLE_START")], RAW["raw_event_types"]),
        "raw_error_codes": spark.createDataFrame([("E", "LOW", "d", True)], RAW["raw_error_codes"]),
    }


def test_selection():
    s = telemetry.select
    assert s("bronze.*") == {n for n in telemetry.models if n.startswith("bronze_")}
    assert s("agg_error_analysis") == {"agg_error_analysis"}
    assert "bronze_error_codes" in s("+agg_error_analysis") and "bronze_error_codes" not in s("+dim_machine_status")
    assert s("silver_fact_error_events+") == {"silver_fact_error_events", "agg_error_analysis"}
    assert s("tag:tec tag:frequency") == {n for n in telemetry.models if "_tec_" in n or "frequency" in n}
    assert {"bronze_machines", "agg_error_analysis"} <= s("+silver_fact_error_events+")
    old = telemetry.state() | {"bronze_machines": "other"}
    assert s("state:modified", old) == {"bronze_machines"} and "agg_error_analysis" in s("state:modified+", old)
    assert s() == set(telemetry.models) and len(telemetry.models) == 19
    with pytest.raises(ValueError):
        s("nothing_like_it")


def test_order_layers_and_lineage():
    order = telemetry.order()
    assert all(order.index(d) < order.index(n) for n, m in telemetry.models.items() for d in m.deps if d in telemetry.models)
    assert json.loads(telemetry.lineage())["agg_error_analysis"]["depends_on"] == ["silver_fact_error_events", "silver_dim_machines"]
    r = Registry()
    r.model("bronze", [])(lambda ctx: None)
    with pytest.raises(ValueError, match="must not refer"):
        r.model("gold", ["<lambda>"])(lambda ctx: None)


def test_full_build_then_a_second_day(spark, tmp_path):
    ctx = Context(spark, str(tmp_path), raw(spark), started=at(0))
    first = run(telemetry, ctx)
    assert [o for o in first if o.status != "PASS"] == []
    assert sum(len(o.checks) for o in first) > 60
    log = ctx.ref("silver_tec_batch_execution_log")
    assert quality.exit_code(pipeline.test_sources(ctx)) == 0
    scanned = pipeline.scan(Context(spark, str(tmp_path), raw(spark), started=at(90_000)), T0.date(), T0.date())
    # A mean gap is missing nowhere and nothing else fails: all of it is data of the one day.
    assert [r for r in scanned if not r.passed] == [] and len(scanned) == 22
    assert {(r.model_name, r.row_count) for r in log.collect()} == {("agg_event_frequency_minute", 12), ("agg_event_frequency_hour", 2), ("agg_event_frequency_day", 2)}
    # Marks are per model: each of the three saw everything, and a rerun sees nothing new.
    again = Context(spark, str(tmp_path), {}, started=at(1))
    run(telemetry, again, "tag:frequency")
    assert {r.row_count for r in again.ref("silver_tec_batch_execution_log").filter(F.col("batch_run_id") == again.run_id).collect()} == {0}
    # The next day brings its own load only.
    day = T0.date() + dt.timedelta(1)
    both = {k: v.unionByName(raw(spark)[k]) if k == "raw_device_events" else v for k, v in raw(spark, day).items()}
    second = Context(spark, str(tmp_path), both, {"load_date": day}, started=at(90_000))
    assert all(o.status == "PASS" for o in run(telemetry, second, threads=4))
    assert {r.row_count for r in second.ref("silver_tec_batch_execution_log").filter(F.col("batch_run_id") == second.run_id).collect()} == {12, 2}
    assert second.ref("bronze_device_events").count() == 24
    assert second.ref("silver_fact_device_events").count() == 24
    assert second.ref("bronze_machines").count() == 2
    assert second.ref("silver_tec_watermark").count() == 3 * 2
    full = Context(spark, str(tmp_path), raw(spark), full_refresh=True, started=at(0))
    assert all(o.status == "PASS" for o in run(telemetry, full)) and full.ref("bronze_device_events").count() == 12


def test_a_failed_check_or_error_skips_what_depends_on_it(spark, tmp_path):
    r = Registry()

    @r.model("bronze", [], "table", checks={"min_rows": 5})
    def few(ctx):
        return ctx.spark.range(3)

    @r.model("silver", ["few"])
    def below(ctx):
        return ctx.ref("few")

    @r.model("silver", [])
    def broken(ctx):
        raise RuntimeError("no")

    @r.model("silver", [])
    def alone(ctx):
        return ctx.spark.range(1)

    got = {o.model: o.status for o in run(r, Context(spark, str(tmp_path), {}))}
    assert got == {"few": "FAIL", "below": "SKIP", "broken": "ERROR", "alone": "PASS"}


def test_unsound_raw_tables_stop_what_reads_them(spark, tmp_path):
    given = raw(spark)
    given["raw_machines"] = given["raw_machines"].unionByName(given["raw_machines"])
    ctx = Context(spark, str(tmp_path), given, started=at(0))
    got = {o.model: o.status for o in run(telemetry, ctx, "bronze.*")}
    assert got["raw_machines"] == "FAIL" and got["bronze_machines"] == "SKIP"
    assert got["raw_event_types"] == got["bronze_event_types"] == "PASS"
    assert [o.model for o in run(telemetry, ctx, "bronze_machines", test=False)] == ["bronze_machines"]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from millrace import __main__ as command

    monkeypatch.setattr(command, "build_session", lambda _: spark)
    for name, df in raw(spark).items():
        files.write_csv(df, str(tmp_path / "seeds" / f"{name}.csv"))
    root = ["--root", str(tmp_path / "w")]
    assert command.main(["seed", *root, "--seeds", str(tmp_path / "seeds")]) == 0
    assert (tmp_path / "w" / "raw" / "raw_machines").is_dir() and "raw_machines" in capsys.readouterr().out
    # Without --seeds the stored tables are read, and checked.
    assert command.main(["build", *root, "--select", "+silver_fact_device_events+ bronze_error_codes"]) == 0
    assert "PASS raw_device_events" in capsys.readouterr().out
    day = str(T0.date())
    assert command.main(["scan", *root, "--from", day, "--to", day]) == 0
    assert command.main(["scan", *root, "--from", "2001-01-01", "--to", "2001-01-02"]) == 1
    with pytest.raises(SystemExit):
        command.main(["scan", *root])


def test_every_column_has_a_comment():
    from millrace import schemas

    for schema in [*RAW.values(), *BRONZE.values(), WATERMARK, schemas.KPI_MAPPING, schemas.BATCH_LOG]:
        assert all(f.metadata.get("comment") for f in schema)


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), WATERMARK)
    assert table.version() == 0 and table.read().count() == 0
    one = spark.createDataFrame([("M", "A", at(0)), ("M", "B", at(0)), (None, "A", at(0))], WATERMARK)
    base = table.version()
    table.commit(one, base)
    with pytest.raises(StaleVersion):
        table.commit(one, base)
    new = spark.createDataFrame([("M", "A", at(9)), ("N", "A", at(9))], WATERMARK)
    table.change(lambda s: upsert(s, new, ["machine_id", "event_type_code"]))
    assert {(r[0], r[1], r[2]) for r in table.read().collect()} == {("M", "A", at(9)), ("N", "A", at(9)), ("M", "B", at(0)), (None, "A", at(0))}
    assert upsert(one, new, ["machine_id", "event_type_code"], insert=False).count() == 3
    assert table.read(1).count() == 3
    moved = update(one, F.col("event_type_code") == "B", last_processed_event_timestamp=F.lit(None).cast("timestamp_ntz"))
    assert {r[1]: r[2] for r in moved.filter("machine_id = 'M'").collect()} == {"A": at(0), "B": None}
    assert delete(one, F.col("machine_id").like("M%")).count() == 1


def test_a_broken_commit_leaves_the_version_before(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), WATERMARK)
    one = spark.createDataFrame([("M", "A", at(0))], WATERMARK)
    table.commit(one, 0)
    # A writer that ended between its marker's beginning and its place: the marker lies beside, half written.
    (tmp_path / "s" / "_versions" / "_data-lost").write_text("")
    assert table.version() == 1 and table.read().count() == 1
    assert table.change(lambda s: s.unionByName(s)) == 2 and table.read().count() == 2
    with pytest.raises(StaleVersion):
        table.commit(one, 1)
    assert table.read().count() == 2
    table.commit(one, 2)
    lost = tmp_path / "s" / "data-lost"
    lost.mkdir()
    assert "data-lost" not in table.vacuum() and set(table.vacuum(1, 0)) >= {"data-lost"}
    assert table._versions() == [3] and table.read().count() == 1


def test_a_change_rewrites_only_the_buckets_it_is_about(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), WATERMARK, ["machine_id"], 8)
    rows = [(f"M{i}", "A", at(i)) for i in range(40)]
    table.commit(spark.createDataFrame(rows, WATERMARK), 0)
    before = table._folders(1)
    new = spark.createDataFrame([("M3", "A", at(99)), ("N", "A", at(1))], WATERMARK)
    table.change_keys(new, lambda s: upsert(s, new, ["machine_id"]))
    after = table._folders(2)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(before) > 4
    got = {r.machine_id: r.last_processed_event_timestamp for r in table.read().collect()}
    assert got == {f"M{i}": at(i) for i in range(40)} | {"M3": at(99), "N": at(1)}
    assert table.change_keys(new.limit(0), lambda s: s) == 2
    assert table.read(1).count() == 40


def test_overwrite_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    files.overwrite(spark.range(3), path)
    files.overwrite(files.read(spark, path).filter("id > 0"), path)
    assert files.read(spark, path).count() == 2 and [p.name for p in tmp_path.iterdir() if p.name != "t"] == []
    with pytest.raises(Exception):
        files.overwrite(spark.range(3).selectExpr("raise_error('no') x"), path)
    assert files.read(spark, path).count() == 2


def test_no_folder_of_one_machine_on_a_cluster():
    from millrace.session import checkpoint_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Cluster)


def test_entry_without_a_package_of_the_text_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("millrace.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "regex", None)
    assert "p1_found" in entry.queries() and "p6_ids" not in entry.queries()


def test_seeds_appends_and_texts(spark, tmp_path):
    src = raw(spark)["raw_event_types"]
    files.write_csv(src, str(tmp_path / "csv"))
    back = files.seed(spark, str(tmp_path / "csv"), "raw_event_types")
    assert back.schema == RAW["raw_event_types"] and sorted(back.collect()) == sorted(src.collect())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("machine_id,machine_type,model_name,manufacturer,plant_location,plant_country,install_date,rated_capacity,capacity_unit,initial_firmware_version\na,b,c,d,e,f,not a date,1,u,v\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.seed(spark, str(tmp_path / "bad"), "raw_machines").collect()
    stamped = src.withColumn("_loaded_at", F.lit(T0))
    stamped = stamped.withColumn("_loaded_at", F.col("_loaded_at").cast("timestamp_ntz"))
    for _ in range(2):
        files.append(stamped, str(tmp_path / "t"), BRONZE["bronze_event_types"])
    assert files.read(spark, str(tmp_path / "t")).count() == 4
    with pytest.raises(files.SchemaDrift):
        files.append(src, str(tmp_path / "t"), BRONZE["bronze_event_types"])
    assert files.as_text(files.values(spark, [("a", None)], WATERMARK[:2])).splitlines()[2] == "a"
    assert [r.ordinal_position for r in files.describe(src).collect()] == [1, 2, 3, 4]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (5, None)], "n int, s string")
    assert quality.not_null(df, "n").count() == 1 and quality.unique(df, "n").count() == 1
    assert quality.accepted_values(df, "s", ["a"]).count() == 1 and quality.between(df, "n", 2, None).count() == 2
    assert quality.accepted_values(df, "s", ["b"], F.col("n") == 1).count() == 1
    assert quality.relationships(df, "s", spark.createDataFrame([("b",), (None,)], "k string"), "k").count() == 2
    assert quality.unique_combination(df.unionByName(df), ["n", "s"]).count() == 4
    results = quality.run(quality.parse("t", {"not_null": ["n"], "unique": ["s"], "min_rows": 1}) + [quality.Check("x", "t", lambda t: t["missing"])], {"t": df})
    assert [r.passed for r in results] == [False, False, True, False] and results[3].error and quality.exit_code(results) == 1
    assert quality.exit_code(results[2:3]) == 0
    mixed = quality.run(quality.parse("t", {"not_null": ["n", "absent"], "between": [("n", 0, 3)]}), {"t": df})
    assert [(r.failures, r.error is None) for r in mixed] == [(1, True), (0, False), (1, True)]
    m = quality.metrics(df, "s", "n").collect()[0]
    assert (m.row_count, m.duplicate_count, m.missing_count) == (4, 1, 1)
    v = "machine_id string, machine_sk string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    dim = spark.createDataFrame([("a", "1", at(0), at(9), False), ("a", "2", at(5), None, True), ("b", "3", at(0), at(5), False)], v)
    assert [r.machine_sk for r in quality.scd2_overlap(dim).collect()] == ["2"] and [r.machine_id for r in quality.one_current(dim).collect()] == ["b"]


def test_streams(spark, tmp_path):
    batch = lambda rows: events(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    batch([{"event_id": "a", "event_timestamp": at(0), "status_value": "old"}, {"event_id": "a", "event_timestamp": at(0), "status_value": "new", "source_ingested_at": at(5)}, {"event_id": "x", "machine_id": None, "event_timestamp": at(0)}])
    state = StateTable(spark, str(tmp_path / "state"), BRONZE["bronze_device_events"], ["event_id"], 4)

    def go():
        streams.conform_into(streams.landed(spark, str(tmp_path / "land")), state, str(tmp_path / "cp")).awaitTermination()
        return {r.event_id: r.status_value for r in state.read().collect()}

    assert go() == {"a": "new"}
    batch([{"event_id": "a", "event_timestamp": at(0), "status_value": "older", "source_ingested_at": at(1)}, {"event_id": "b", "event_timestamp": at(4000)}])
    assert go() == {"a": "new", "b": None}
    for name, df in (("counts", streams.windowed_counts(streams.landed(spark, str(tmp_path / "land")), "1 hour")), ("sessions", streams.session_counts(streams.landed(spark, str(tmp_path / "land"))))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert {(r.bucket_start, r.event_count) for r in spark.table("counts").filter("machine_id = 'M'").collect()} == {(at(0), 3), (at(3600), 1)}
    assert sorted(r.event_count for r in spark.table("sessions").filter("machine_id = 'M'").collect()) == [1, 3]
    once = streams.once_within(streams.landed(spark, str(tmp_path / "land")))
    q = once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "o")).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == ["a", "b", "x"]


def test_writer_count():
    assert set(pipeline.FREQUENCY) == {m for m in telemetry.models if m.startswith("agg_event_frequency")}


def test_tables_lie_in_the_namespace_of_their_layer(spark, tmp_path):
    r = pipeline.Registry()
    build = lambda name: (lambda f: (setattr(f, "__name__", name), f)[1])(lambda ctx: ctx.spark.range(2))
    r.model("silver", materialized="table")(build("one"))
    r.model("silver", materialized="table", schema=" own ")(build("two"))
    ctx = Context(spark, str(tmp_path), {}, registry=r)
    assert ctx.tables().count() == 0
    files.overwrite(spark.range(1), str(tmp_path / "old"))
    r.model("silver", materialized="table")(build("old"))
    assert [o.status for o in run(r, ctx)] == ["PASS"] * 3
    assert [tuple(x) for x in ctx.tables().collect()] == [(None, "old"), ("own", "two"), ("silver", "one")]
    assert [ctx.ref(n).count() for n in ("one", "two", "old")] == [2, 2, 2]
    assert ctx.path("two") == f"{tmp_path}/own/two" and ctx.path("silver_dim_machines") == f"{tmp_path}/silver_dim_machines"
    assert Context(spark, str(tmp_path), {}).path("silver_dim_machines") == f"{tmp_path}/silver/silver_dim_machines"
