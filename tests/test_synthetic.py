import datetime as dt

from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.plans import pipeline
from millrace.schemas import RAW
from millrace.sources import files, synthetic

DAY = dt.date(2026, 4, 1)


def made(spark, per=60):
    codes = spark.createDataFrame([(f"E{i}", s, "d", i % 2 == 0) for i, s in enumerate(synthetic.SEVERITIES)], RAW["raw_error_codes"])
    fleet = synthetic.machines(spark, 12)
    return fleet, codes, synthetic.device_events(spark, fleet, codes, DAY, 5, per)


def test_same_rows_on_any_partitions_and_expected_shares(spark):
    fleet, codes, events = made(spark, 300)
    again = synthetic.device_events(spark, fleet.repartition(7), codes.repartition(3), DAY, 5, 300)
    assert events.schema == again.schema and [f.name for f in events.schema] == RAW["raw_device_events"].fieldNames()
    assert events.exceptAll(again).count() == again.exceptAll(events).count() == 0
    n = events.count()
    assert 0.01 < (n - events.select("event_id").distinct().count()) / n < 0.03
    assert 0.001 < events.filter("machine_id is null").count() / n < 0.012
    assert events.filter((F.to_date("event_timestamp") < DAY) | (F.col("load_date") > DAY + dt.timedelta(4)) | (F.col("source_ingested_at") < F.col("event_timestamp"))).count() == 0
    weekend = {r[0]: r[1] for r in events.groupBy(F.dayofweek("event_date").isin(1, 7)).count().collect()}
    assert weekend[True] / 2 < 0.6 * weekend[False] / 3
    raised, resolved = (events.filter(F.col("event_type_code") == k).select("event_id").distinct().count() for k in ("ERROR_RAISED", "ERROR_RESOLVED"))
    assert raised == resolved == 36


def test_generated_data_runs_through_the_command_line(spark, tmp_path, capsys, monkeypatch):
    fleet, codes, events = made(spark)
    types = spark.createDataFrame([(c, "telemetry", "d", True) for c in [*synthetic.DENSE, "STATUS_CHANGE", "ERROR_RAISED", "ERROR_RESOLVED", "MAINTENANCE_ALERT"]], RAW["raw_event_types"])
    for name, df in (("raw_machines", fleet), ("raw_error_codes", codes), ("raw_event_types", types), ("raw_device_events", events)):
        files.write_csv(df, str(tmp_path / "seeds" / f"{name}.csv"))
    common = ["--root", str(tmp_path / "w"), "--seeds", str(tmp_path / "seeds")]
    assert main(["run", *common]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 19 and all(line.startswith("PASS") for line in out)
    assert main(["test", *common, "--select", "silver_dim_machines silver_fact_error_events"]) == 0
    assert "PASS silver_dim_machines: scd2_overlap 0" in capsys.readouterr().out
    assert main(["show", *common, "--select", "agg_error_analysis"]) == 0 and main(["ls", "--select", "tag:tec"]) == 0
    ctx = pipeline.Context(spark, str(tmp_path / "w"), {})
    assert ctx.ref("silver_fact_error_events").count() > 20 and ctx.ref("silver_dim_machines").filter("is_current").count() == 12
