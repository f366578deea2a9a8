"""The models of the telemetry pipeline, from raw rows to reporting tables, as pure functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import surrogate_key
from millrace.functions.temporal import seconds_between
from millrace.operators.frequency import EPOCH, KEYS, MARK
from millrace.operators.intervals import by_day, seconds_in_day
from millrace.operators.latest import latest, quarantine
from millrace.operators.neighbours import with_next
from millrace.schemas import BATCH_LOG, BRONZE, DOWN, READINGS, SENSORS

Instant = dt.datetime | None


def _stamp(at: Instant) -> Column:
    now = F.current_timestamp() if at is None else F.lit(at.isoformat(sep=" "))
    return now.cast("timestamp_ntz").alias("_loaded_at")


# ---- bronze: typed and stamped, nothing removed


def bronze(raw: DataFrame, name: str, loaded_at: Instant = None, load_date: dt.date | None = None) -> DataFrame:
    """``raw`` cast to the types of the bronze table ``name`` and stamped; of one load date if given.

    Columns beyond the table's are dropped, missing ones raise, and so do values that do not cast.
    """
    schema = BRONZE[name]
    if load_date is not None:
        raw = raw.filter(F.col("load_date").cast("date") == F.lit(load_date))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name != "_loaded_at"], _stamp(loaded_at))


# ---- silver


def _newest(df: DataFrame, key: str) -> DataFrame:
    ties = [F.col(c) for c in sorted(df.columns) if c not in (key, "_loaded_at")]
    return latest(df, [key], [F.col("_loaded_at").desc(), *ties])


def _deliveries() -> list[Column]:
    return [
        F.col("source_ingested_at").desc(), F.col("_loaded_at").desc(), F.col("load_date").desc(), F.col("machine_id"),
        F.col("event_type_code"), F.col("event_timestamp"),
    ]


def conformed_events(events: DataFrame) -> DataFrame:
    """Events with a machine, one copy of each: quarantine comes first, so a sound older copy survives."""
    sound, _ = quarantine(events, F.col("machine_id").isNotNull())
    return latest(sound, ["event_id"], _deliveries())


def event_value() -> Column:
    """The reading that an event's type stands for, as double."""
    value = F.lit(None).cast("double")
    for code, column in READINGS.items():
        value = F.when(F.col("event_type_code") == code, F.col(column).cast("double")).otherwise(value)
    return value


def fact_device_events(events: DataFrame, machines: DataFrame, event_types: DataFrame) -> DataFrame:
    """Conformed events of known machines with their category; unknown types keep a null category."""
    m = _newest(machines, "machine_id").select("machine_id", "plant_location")
    t = _newest(event_types, "event_type_code").select("event_type_code", "event_category")
    e = conformed_events(events)
    joined = e.join(m, "machine_id").join(t, "event_type_code", "left")
    return joined.select(
        "event_id", "machine_id", "machine_type", "plant_location", "event_type_code", "event_category",
        "event_timestamp", "event_date", "status_value", "temperature_c", "speed_units_per_min", "vibration_mm_s",
        "product_count", "cycle_duration_seconds", "error_code", event_value().alias("event_value"),
        "source_ingested_at", "load_date",
    )


def dim_machines(events: DataFrame, machines: DataFrame) -> DataFrame:
    """The status history of every machine: one version per change, open at the end.

    Two changes at one instant leave the one of the least event_id. Machines without change have no row.
    """
    status = events.filter((F.col("event_type_code") == "STATUS_CHANGE") & F.col("machine_id").isNotNull())
    status = latest(status, ["event_id"], _deliveries())
    changes = latest(status, ["machine_id", "event_timestamp"], [F.col("event_id")])
    changes = changes.select("machine_id", "status_value", F.col("event_timestamp").alias("valid_from"))
    m = _newest(machines, "machine_id").select(
        "machine_id", "machine_type", "plant_location", F.col("initial_firmware_version").alias("firmware_version")
    )
    spans = with_next(changes.join(m, "machine_id"), ["machine_id"], "valid_from", [], {"valid_to": "valid_from"})
    key = surrogate_key((F.col("machine_id"), "string"), (F.col("valid_from"), "timestamp"))
    return spans.select(
        key.alias("machine_sk"), "machine_id", "machine_type", "status_value", "plant_location", "firmware_version",
        "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"),
    )


def _paired(fact: DataFrame) -> DataFrame:
    errors = fact.filter(F.col("event_type_code").isin("ERROR_RAISED", "ERROR_RESOLVED")).select(
        "event_id", "machine_id", "error_code", "event_type_code", "event_timestamp"
    )
    carry = {"_next_ts": "event_timestamp", "_next_type": "event_type_code"}
    paired = with_next(errors, ["machine_id", "error_code"], "event_timestamp", ["event_id"], carry)
    return paired.filter(F.col("event_type_code") == "ERROR_RAISED")


def fact_error_events(fact: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Faults from a raise to the resolution that follows it directly; others drop out."""
    codes = _newest(error_codes, "error_code").select("error_code", "severity", "requires_maintenance")
    closed = _paired(fact).filter(F.col("_next_type") == "ERROR_RESOLVED").join(codes, "error_code")
    key = surrogate_key(
        (F.col("machine_id"), "string"), (F.col("error_code"), "string"), (F.col("event_timestamp"), "timestamp")
    )
    return closed.select(
        key.alias("error_event_sk"), "machine_id", "error_code", "severity", "requires_maintenance",
        F.col("event_timestamp").alias("raised_at"), F.col("_next_ts").alias("resolved_at"),
        seconds_between(F.col("event_timestamp"), F.col("_next_ts")).alias("resolution_time_seconds"),
    )


def open_faults(fact: DataFrame) -> DataFrame:
    """Raises that no resolution follows directly: those that ``fact_error_events`` leaves out."""
    unresolved = F.coalesce(F.col("_next_type") != "ERROR_RESOLVED", F.lit(True))
    return _paired(fact).filter(unresolved).select(
        "machine_id", "error_code", F.col("event_timestamp").alias("raised_at"), F.col("_next_ts").alias("raised_again_at")
    )


def combinations(machines: DataFrame, event_types: DataFrame) -> DataFrame:
    """Every machine with every event type. The types are a fixed list, so this grows with machines alone."""
    m = machines.select("machine_id").distinct()
    return m.crossJoin(event_types.select("event_type_code").distinct())


def seed_watermark(machines: DataFrame, event_types: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Marks at the beginning of time for combinations that ``state`` does not hold yet."""
    new = combinations(machines, event_types)
    if state is not None:
        new = new.join(state, KEYS, "left_anti")
    return new.withColumn(MARK, F.lit(EPOCH).cast("timestamp_ntz"))


def seed_kpi_mapping(machines: DataFrame, event_types: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The KPI code ``all`` for combinations that ``state`` does not hold yet."""
    new = combinations(machines, event_types)
    if state is not None:
        new = new.join(state, KEYS, "left_anti")
    return new.withColumn("kpi_code", F.lit("all"))


def empty_batch_log(like: DataFrame) -> DataFrame:
    """The batch log before any run."""
    return like.sparkSession.createDataFrame([], BATCH_LOG)


def batch_log_row(output: DataFrame, run_id: str, model: str, started: dt.datetime, ended: dt.datetime) -> DataFrame:
    """One row about a run's output: buckets, machines, event types, whole seconds, begin and end."""
    seconds = int((ended - started).total_seconds())
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return output.agg(
        F.lit(run_id).alias("batch_run_id"), F.lit(model).alias("model_name"), F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("machine_id").alias("distinct_machine_count"),
        F.countDistinct("event_type_code").alias("distinct_event_count"),
        F.lit(seconds).cast("bigint").alias("duration_seconds"), at(started).alias("run_started_at"),
        at(ended).alias("run_completed_at"),
    )


# ---- gold


def machine_status(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """Every machine's current status with its latest reading of each sensor."""
    now = dim.filter("is_current").select(
        "machine_id", "machine_type", "status_value", "plant_location", "firmware_version",
        F.col("valid_from").alias("status_since"),
    )
    return now.join(latest_readings(fact), "machine_id", "left")


def latest_readings(fact: DataFrame) -> DataFrame:
    """Per machine the latest reading of each sensor and its instant, in one aggregation."""
    read = fact.filter(F.col("event_type_code").isin(*SENSORS))
    newest = F.struct("event_timestamp", "event_id", "event_value")
    wide = read.groupBy("machine_id").agg(
        *[F.max(F.when(F.col("event_type_code") == code, newest)).alias(f"_{name}") for code, (name, _) in SENSORS.items()]
    )
    columns = []
    for name, column in SENSORS.values():
        columns.append(F.col(f"_{name}.event_value").alias(f"latest_{column}"))
        columns.append(F.col(f"_{name}.event_timestamp").alias(f"latest_{name}_at"))
    return wide.select("machine_id", *columns)


def status_history(dim: DataFrame) -> DataFrame:
    return dim.select(
        "machine_sk", "machine_id", "machine_type", "status_value", "plant_location", "firmware_version", "valid_from",
        "valid_to", "is_current",
    )


def uptime_daily(dim: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Seconds and shares per machine and day by kind of status; open versions last until ``as_of``."""
    until = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    spread = by_day(dim, "valid_from", "valid_to", until)
    seconds = seconds_in_day(F.col("valid_from"), F.coalesce("valid_to", until), F.col("day"))
    kind = F.col("status_value")
    part = lambda c: F.sum(F.when(c, F.col("_s")).otherwise(0))
    daily = spread.withColumn("_s", seconds).groupBy("machine_id", "machine_type", F.col("day").alias("event_date")).agg(
        F.sum("_s").alias("total_seconds"),
        part(kind == "RUNNING").alias("running_seconds"),
        part(kind.isin(*DOWN)).alias("down_seconds"),
        part(kind == "IDLE").alias("idle_seconds"),
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.nullif(F.col("total_seconds"), F.lit(0)), 2)
    return daily.withColumns(
        {"pct_running": share("running_seconds"), "pct_down": share("down_seconds"), "pct_idle": share("idle_seconds")}
    )


def type_performance(fact: DataFrame) -> DataFrame:
    """Mean and number of readings per machine type, day and sensor; empty readings count, but not in the mean."""
    read = fact.filter(F.col("event_type_code").isin(*SENSORS))
    of = lambda code, c: F.when(F.col("event_type_code") == code, c)
    means = [F.avg(of(code, F.col("event_value"))).alias(f"avg_{column}") for code, (_, column) in SENSORS.items()]
    counts = [F.count(of(code, F.lit(1))).alias(f"{name}_reading_count") for code, (name, _) in SENSORS.items()]
    return read.groupBy("machine_type", "event_date").agg(*means, *counts)


def error_analysis(errors: DataFrame, dim: DataFrame) -> DataFrame:
    """Faults per machine type and severity: number, mean time to resolution, those that need maintenance."""
    kinds = dim.select("machine_id", "machine_type").distinct()
    return errors.join(kinds, "machine_id").groupBy("machine_type", "severity").agg(
        F.count(F.lit(1)).alias("error_count"),
        F.avg("resolution_time_seconds").alias("avg_resolution_time_seconds"),
        F.sum(F.when(F.col("requires_maintenance"), 1).otherwise(0)).alias("maintenance_required_count"),
    )


def production_output(fact: DataFrame) -> DataFrame:
    """Products and cycles per machine and day; days without production have zeros."""
    kind, n = F.col("event_type_code"), F.col("product_count")
    done = kind == "CYCLE_COMPLETE"
    return fact.groupBy("machine_id", "machine_type", "event_date").agg(
        F.sum(F.when(kind == "PRODUCT_COUNT_UPDATE", n).otherwise(0)).alias("total_product_count"),
        F.count(F.when(kind == "CYCLE_START", 1)).alias("cycle_start_count"),
        F.count(F.when(done, 1)).alias("cycle_complete_count"),
        F.sum(F.when(done, n).otherwise(0)).alias("cycle_product_count"),
        F.avg(F.when(done, F.col("cycle_duration_seconds"))).alias("avg_cycle_duration_seconds"),
    )
