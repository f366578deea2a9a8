"""Queries over the telemetry models and their operators, with the SQL that checks them.

Landing tables are the given bronze tables; reports are taken over the given silver tables, and the
silver models are built from bronze beside them.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import quality
from millrace.functions.temporal import bucket, seconds_between
from millrace.operators import frequency, intervals, latest, models
from millrace.schemas import BRONZE, DOWN, READINGS, SENSORS, STATUSES
from millrace.session import table
from millrace.sources import files, state

FACT, DIM = "silver_fact_device_events", "silver_dim_machines"
#: The instant at which open versions end in reports, the mark of the incremental run, and the landing's stamp.
AS_OF = dt.datetime(2019, 2, 1)
MARK = dt.datetime(2019, 1, 11, 12)
LANDED = dt.datetime(2019, 2, 1, 6)
LOAD_DATE = dt.date(2019, 1, 18)
RUN = ("run-1", "agg_event_frequency_day", dt.datetime(2019, 2, 1, 6), dt.datetime(2019, 2, 1, 6, 1, 30))


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


def _raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The landing table as its source delivers it: text, without stamp."""
    df = table(spark, d, name).drop("_loaded_at")
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _bronze_query(name: str, load_date: dt.date | None = None):
    return lambda spark, d: models.bronze(_raw(spark, d, name), name, LANDED, load_date)


def _bronze_sql(name: str, where: str = "") -> str:
    stamp = "timestamp '2019-02-01 06:00:00'"
    return f"select * exclude (_loaded_at), {stamp} _loaded_at from {name} {where}"


def _built_fact(spark: SparkSession, d: str) -> DataFrame:
    return models.fact_device_events(*(table(spark, d, f"bronze_{t}") for t in ("device_events", "machines", "event_types")))


def _built_dim(spark: SparkSession, d: str) -> DataFrame:
    return models.dim_machines(table(spark, d, "bronze_device_events"), table(spark, d, "bronze_machines"))


_DELIVERED = "source_ingested_at desc, _loaded_at desc, load_date desc, machine_id, event_type_code, event_timestamp"
_CTE = f"""
m as (select * from (select *, row_number() over (partition by machine_id order by _loaded_at desc, capacity_unit,
    initial_firmware_version, install_date, machine_type, manufacturer nulls first, model_name, plant_country,
    plant_location, rated_capacity nulls first) k from bronze_machines) where k = 1),
t as (select * from (select *, row_number() over (partition by event_type_code order by _loaded_at desc, description,
    event_category, has_numeric_payload) k from bronze_event_types) where k = 1),
c as (select * from (select *, row_number() over (partition by error_code order by _loaded_at desc, description,
    requires_maintenance, severity) k from bronze_error_codes) where k = 1),
e as (select * from (select *, row_number() over (partition by event_id order by {_DELIVERED}) k
    from bronze_device_events where machine_id is not null) where k = 1)"""
_VALUE = "case " + " ".join(f"when event_type_code = '{k}' then {v}::double" for k, v in READINGS.items()) + " end"
_FACT_SQL = f"""with {_CTE}
select event_id, e.machine_id, e.machine_type, m.plant_location, e.event_type_code, t.event_category, event_timestamp,
  event_date, status_value, temperature_c, speed_units_per_min, vibration_mm_s, product_count, cycle_duration_seconds,
  error_code, {_VALUE.replace("event_type_code", "e.event_type_code")} event_value, source_ingested_at, load_date
from e join m on m.machine_id = e.machine_id left join t on t.event_type_code = e.event_type_code"""
_DIM_SQL = f"""with {_CTE},
s as (select * from (select *, row_number() over (partition by event_id order by {_DELIVERED}) k2
    from bronze_device_events where machine_id is not null and event_type_code = 'STATUS_CHANGE') where k2 = 1),
u as (select * from (select *, row_number() over (partition by machine_id, event_timestamp order by event_id) k3 from s)
    where k3 = 1),
dim as (
  select md5(u.machine_id || '|' || epoch_us(event_timestamp)::varchar) machine_sk, u.machine_id, m.machine_type,
    u.status_value, m.plant_location, m.initial_firmware_version firmware_version, event_timestamp valid_from,
    lead(event_timestamp) over (partition by u.machine_id order by event_timestamp) valid_to
  from u join m on m.machine_id = u.machine_id)
select *, valid_to is null is_current from dim"""
_ERRORS = f"""{_CTE},
p as (
  select *, lead(event_timestamp) over w n_ts, lead(event_type_code) over w n_type
  from {FACT} where event_type_code in ('ERROR_RAISED', 'ERROR_RESOLVED')
  window w as (partition by machine_id, error_code order by event_timestamp, event_id)),
errs as (
  select md5(p.machine_id || '|' || p.error_code || '|' || epoch_us(event_timestamp)::varchar) error_event_sk,
    machine_id, p.error_code, c.severity, c.requires_maintenance, event_timestamp raised_at, n_ts resolved_at,
    date_diff('second', event_timestamp, n_ts) resolution_time_seconds
  from p join c on c.error_code = p.error_code where event_type_code = 'ERROR_RAISED' and n_type = 'ERROR_RESOLVED')"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return models.fact_error_events(table(spark, d, FACT), table(spark, d, "bronze_error_codes"))


# ---- state


def _masters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "bronze_machines"), table(spark, d, "bronze_event_types")


def _some_state(spark: SparkSession, d: str) -> DataFrame:
    """Marks that exist already: those of slicers, in the middle of the data."""
    machines, types = _masters(spark, d)
    seeded = models.seed_watermark(machines.filter(F.col("machine_type") == "SLICER"), types)
    return seeded.withColumn(frequency.MARK, F.lit(MARK.isoformat(sep=" ")).cast("timestamp_ntz"))


_STATE_SQL = """
st as (select distinct machine_id, t.event_type_code, timestamp '2019-01-11 12:00:00' last_processed_event_timestamp
  from bronze_machines cross join bronze_event_types t where machine_type = 'SLICER')"""


def _frequency_query(grain: str, incremental: bool = False):
    def query(spark: SparkSession, d: str) -> DataFrame:
        marks = _some_state(spark, d) if incremental else None
        return frequency.event_frequency(table(spark, d, FACT), grain, marks)

    return query


def freq_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The daily table merged from minutes by way of hours: one pass over the events serves all grains."""
    minutes = frequency.partials(table(spark, d, FACT), "minute")
    return frequency.finish(frequency.coarser(frequency.coarser(minutes, "hour"), "day"))


def _frequency_sql(grain: str, incremental: bool = False) -> str:
    join = "left join st w on w.machine_id = e.machine_id and w.event_type_code = e.event_type_code" if incremental else ""
    since = "coalesce(w.last_processed_event_timestamp, timestamp '1900-01-01')" if incremental else "timestamp '1900-01-01'"
    return f"""with {_STATE_SQL},
n as (select e.* from {FACT} e {join} where e.event_timestamp > {since}),
g as (
  select *, date_diff('second', lag(event_timestamp) over w, event_timestamp) gap,
    date_trunc('{grain}', event_timestamp)::timestamp bucket_start
  from n window w as (partition by machine_id, event_type_code order by event_timestamp)),
r as (
  select *, max(event_value) over w hi,
    case when count(event_value) over w = count(*) over w then min(event_value) over w end lo
  from g window w as (partition by machine_id, event_type_code, bucket_start))
select machine_id, event_type_code, bucket_start, count(*) event_count, min(event_timestamp) first_event_timestamp,
  max(event_timestamp) last_event_timestamp,
  min(event_timestamp) filter (where event_value is not distinct from lo) timestamp_of_min_value,
  min(event_timestamp) filter (where event_value is not distinct from hi) timestamp_of_max_value,
  avg(gap) avg_seconds_between_events
from r group by 1, 2, 3"""


def watermark_advance(spark: SparkSession, d: str) -> DataFrame:
    """Marks after an incremental daily run from them."""
    marks = _some_state(spark, d)
    return frequency.advance(marks, frequency.event_frequency(table(spark, d, FACT), "day", marks))


def watermark_rewind(spark: SparkSession, d: str) -> DataFrame:
    """An UPDATE of some marks."""
    marks = _some_state(spark, d)
    mine = F.col("event_type_code") == "STATUS_CHANGE"
    return state.update(marks, mine, **{frequency.MARK: F.lit(frequency.EPOCH).cast("timestamp_ntz")})


def delete_demo(spark: SparkSession, d: str) -> DataFrame:
    """Inserted demonstration rows deleted again by pattern, with one kept that does not match."""
    known = table(spark, d, "bronze_event_types").select("event_type_code", "description")
    demo = files.values(spark, [("demo-1", "a"), ("demo-2", None), ("kept-1", "c")], known.schema)
    return state.delete(known.unionByName(demo), F.col("event_type_code").like("demo-%"))


def watermark_merge(spark: SparkSession, d: str) -> DataFrame:
    """An upsert by composite key: some rows replaced, some new."""
    machines, types = _masters(spark, d)
    source = models.seed_watermark(machines.filter(F.col("machine_type").isin("SLICER", "BAKER")), types)
    return state.upsert(_some_state(spark, d), source.filter(F.col("event_type_code") != "CYCLE_START"), frequency.KEYS)


def batch_log_row(spark: SparkSession, d: str) -> DataFrame:
    return models.batch_log_row(frequency.event_frequency(table(spark, d, FACT), "day"), *RUN)


# ---- reports


def as_of_status(spark: SparkSession, d: str) -> DataFrame:
    """Every event of the landing with the status in force at its instant, nulls where there is none."""
    events = table(spark, d, "bronze_device_events").select("event_id", "machine_id", "event_timestamp", "load_date", "source_ingested_at")
    dim = table(spark, d, DIM).select("machine_id", "status_value", "firmware_version", "valid_from", "valid_to")
    return intervals.as_of(events, dim, ["machine_id"], "event_timestamp", "valid_from", "valid_to")


def day_spine(spark: SparkSession, d: str) -> DataFrame:
    bounds = table(spark, d, DIM).agg(
        F.min(F.to_date("valid_from")).alias("first_day"), F.max(F.to_date(F.coalesce("valid_to", "valid_from"))).alias("last_day")
    )
    return intervals.day_spine(bounds, "first_day", "last_day")


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of every version in every day it touches."""
    until = F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")
    spread = intervals.by_day(table(spark, d, DIM), "valid_from", "valid_to", until)
    seconds = intervals.seconds_in_day(F.col("valid_from"), F.coalesce("valid_to", until), F.col("day"))
    return spread.select("machine_sk", "day", seconds.alias("overlap_seconds"))


def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table, by a union of counts."""
    out = None
    for name in ("bronze_device_events", "bronze_machines", FACT, DIM, "machine_snapshots"):
        part = table(spark, d, name).agg(F.lit(name).alias("object"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out.select("object", "n_rows")


def top_errors(spark: SparkSession, d: str) -> DataFrame:
    """The six commonest kinds of fault: a top-k report."""
    found = models.error_analysis(_errors(spark, d), table(spark, d, DIM))
    return found.orderBy(F.col("error_count").desc(), "machine_type", "severity").limit(6)


def busy_machines(spark: SparkSession, d: str) -> DataFrame:
    """Machines with more than three status versions."""
    return table(spark, d, DIM).groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_versions")).filter("n_versions > 3")


def reading_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, readings and rounded extremes per type, with the total by a scalar subquery."""
    fact = table(spark, d, FACT)
    total = fact.agg(F.count(F.lit(1)).alias("n_total"))
    own = fact.groupBy("event_type_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("event_value").alias("n_values"),
        F.round(F.min("event_value"), 2).alias("least"), F.round(F.max("event_value"), 2).alias("greatest"),
        F.countDistinct("machine_id").alias("n_machines"),
    )
    return own.crossJoin(F.broadcast(total))  # one row


def status_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds per status over closed versions; the window stands below the aggregate."""
    spans = table(spark, d, DIM).select("status_value", seconds_between(F.col("valid_from"), F.col("valid_to")).alias("s"))
    return spans.groupBy("status_value").agg(F.sum("s").alias("total_seconds"))


def columns_of_fact(spark: SparkSession, d: str) -> DataFrame:
    return files.describe(table(spark, d, FACT)).drop("comment")


# ---- data quality: failures per check, with violations that the landing tables hold


def dq_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per check over landing and conformed tables with the number of failing rows.

    Checks of one table share a pass over it, and the fact is built once.
    """
    b = {n: table(spark, d, n) for n in BRONZE}
    fact, events, c = table(spark, d, FACT), b["bronze_device_events"], F.col
    referring = quality.with_parents(events, {
        "machine_id": (b["bronze_machines"], "machine_id"), "event_type_code": (b["bronze_event_types"], "event_type_code"),
        "error_code": (b["bronze_error_codes"], "error_code"),
    })
    ids = quality.copies(events, _built_fact(spark, d))
    parts = [
        quality.tally(referring, {
            "not_null machine_id": c("machine_id").isNull(),
            "accepted_values where": c("product_count").isNotNull() & ~c("event_type_code").isin(*READINGS),
            "relationships machine_id": c("_lost_machine_id"),
            "relationships event_type_code": c("_lost_event_type_code"),
            "relationships error_code": c("_lost_error_code"),
            "between temperature_c": ~c("temperature_c").between(0, 200),
            "between row_condition": (c("event_type_code") == "CYCLE_COMPLETE") & (c("product_count") < 1),
        }),
        quality.tally(ids, {
            "unique event_id": (c("n") > 1) & c("event_id").isNotNull(),
            "lost_events": (c("n_sound") > 0) & c("event_id").isNotNull() & c("kept").isNull(),
            "older_copy_kept": c("kept") != c("newest"),
        }),
        quality.tally(fact.groupBy("event_id").agg(F.count("event_id").alias("n")), {"unique silver event_id": c("n") > 1}),
        quality.tally(table(spark, d, "machine_snapshots"), {"accepted_values status_value": ~c("status_value").isin(*STATUSES)}),
        quality.tally(
            b["bronze_machines"].groupBy("machine_id", "_loaded_at").agg(F.count(F.lit(1)).alias("n")),
            {"unique_combination machine_id, _loaded_at": c("n") > 1},
        ),
        quality.tally(quality.history_of(table(spark, d, DIM)), {"one_current": c("n_current") != 1}),
        quality.history_of(table(spark, d, DIM)).agg(
            F.lit("scd2_overlap").alias("check_name"), F.coalesce(F.sum("n_overlap"), F.lit(0)).alias("failures")
        ),
        quality.tally(frequency.event_frequency(fact, "day"), {"gap_missing": c("avg_seconds_between_events").isNull() & (c("event_count") > 1)}),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


#: Single checks of ``dq_counts`` by the name of their query: the failing rows themselves, and the SQL of them.
def _dq_rows() -> dict:
    t = table
    dim = lambda s, d: t(s, d, DIM)
    return {
        "dq_not_null": (lambda s, d: quality.not_null(t(s, d, "bronze_device_events"), "machine_id"), "select * from bronze_device_events where machine_id is null"),
        "dq_unique": (lambda s, d: quality.unique(t(s, d, "bronze_device_events"), "event_id"),
                      "select event_id, count(*) n_records from bronze_device_events where event_id is not null group by 1 having count(*) > 1"),
        "dq_accepted_values": (lambda s, d: quality.accepted_values(t(s, d, "machine_snapshots"), "status_value", STATUSES),
                               f"select * from machine_snapshots where status_value not in ({_listed(STATUSES)})"),
        "dq_relationships": (lambda s, d: quality.relationships(t(s, d, "bronze_device_events"), "error_code", t(s, d, "bronze_error_codes"), "error_code"),
                             "select * from bronze_device_events where error_code is not null and error_code not in (select error_code from bronze_error_codes)"),
        "dq_unique_combination": (lambda s, d: quality.unique_combination(t(s, d, "bronze_machines"), ["machine_id", "_loaded_at"]),
                                  "select machine_id, _loaded_at, count(*) n_records from bronze_machines group by 1, 2 having count(*) > 1"),
        "dq_between": (lambda s, d: quality.between(t(s, d, "bronze_device_events"), "temperature_c", 0, 200),
                       "select * from bronze_device_events where temperature_c not between 0 and 200"),
        "dq_scd2_overlap": (lambda s, d: quality.scd2_overlap(dim(s, d)), f"""select * from {DIM} b where exists (select 1 from {DIM} a
            where a.machine_id = b.machine_id and a.machine_sk <> b.machine_sk and a.valid_from <= b.valid_from
            and b.valid_from < coalesce(a.valid_to, timestamp '9999-12-31'))"""),
        "dq_one_current": (lambda s, d: quality.one_current(dim(s, d)), f"""select machine_id, count(*) filter (where is_current) current_versions
            from {DIM} group by 1 having count(*) filter (where is_current) <> 1"""),
        "dq_latest_copy_kept": (
            # Held against the first copies, so that there are failures to find.
            lambda s, d: quality.older_copy_kept(t(s, d, "bronze_device_events"), _first_copies(s, d)),
            """with b as (select event_id, max(source_ingested_at) newest, min(source_ingested_at) source_ingested_at from bronze_device_events
            where machine_id is not null group by 1) select event_id, source_ingested_at from b where source_ingested_at <> newest""",
        ),
        "event_value_coalesce": (
            lambda s, d: t(s, d, FACT).select("event_id", F.coalesce("event_value", F.lit(0.0)).alias("event_value")),
            f"select event_id, coalesce(event_value, 0.0)::double event_value from {FACT}",
        ),
        "as_of_orders": (_as_of_orders, """with v as (
            select o_custkey, o_orderstatus, o_orderdate::timestamp valid_from,
              lead(o_orderdate::timestamp) over (partition by o_custkey order by o_orderdate) valid_to from (
              select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) k from orders) where k = 1)
            select event_id, user_id o_custkey, ts, o_orderstatus, valid_from, valid_to from events e left join v
            on v.o_custkey = e.user_id and e.ts >= valid_from and (valid_to is null or e.ts < valid_to)"""),
    }


def _first_copies(spark: SparkSession, d: str) -> DataFrame:
    sound = table(spark, d, "bronze_device_events").filter("machine_id is not null")
    return sound.groupBy("event_id").agg(F.min("source_ingested_at").alias("source_ingested_at"))


def _as_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a user with the status of the user's latest order at its instant."""
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return intervals.as_of(events, order_status_versions(spark, d), ["o_custkey"], "ts", "valid_from", "valid_to")


def dq_metrics(spark: SparkSession, d: str) -> DataFrame:
    return quality.metrics(table(spark, d, "bronze_device_events"), "event_id", "machine_id")


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _dq_sql() -> str:
    listed = _listed
    fk = lambda c, p: f"from bronze_device_events where {c} is not null and {c} not in (select {c} from {p})"
    parts = {
        "not_null machine_id": "from bronze_device_events where machine_id is null",
        "unique event_id": "from (select event_id from bronze_device_events group by 1 having count(*) > 1)",
        "unique silver event_id": f"from (select event_id from {FACT} group by 1 having count(*) > 1)",
        "accepted_values status_value": f"from machine_snapshots where status_value not in ({listed(STATUSES)})",
        "accepted_values where": f"from bronze_device_events where product_count is not null and event_type_code not in ({listed(READINGS)})",
        "relationships machine_id": fk("machine_id", "bronze_machines"),
        "relationships event_type_code": fk("event_type_code", "bronze_event_types"),
        "relationships error_code": fk("error_code", "bronze_error_codes"),
        "unique_combination machine_id, _loaded_at": "from (select 1 from bronze_machines group by machine_id, _loaded_at having count(*) > 1)",
        "between temperature_c": "from bronze_device_events where temperature_c not between 0 and 200",
        "between row_condition": "from bronze_device_events where event_type_code = 'CYCLE_COMPLETE' and product_count < 1",
        "scd2_overlap": f"""from {DIM} b where exists (select 1 from {DIM} a where a.machine_id = b.machine_id
            and a.machine_sk <> b.machine_sk and a.valid_from <= b.valid_from
            and b.valid_from < coalesce(a.valid_to, timestamp '9999-12-31'))""",
        "one_current": f"from (select machine_id from {DIM} group by 1 having count(*) filter (where is_current) <> 1)",
        "lost_events": f"from (select distinct event_id from bronze_device_events where machine_id is not null and event_id not in (select event_id from built))",
        "older_copy_kept": """from built s join (select event_id, max(source_ingested_at) x from bronze_device_events
            where machine_id is not null group by 1) b on b.event_id = s.event_id where s.source_ingested_at <> b.x""",
        "gap_missing": "from freq where avg_seconds_between_events is null and event_count > 1",
    }
    union = " union all ".join(f"select '{k}' check_name, count(*) failures {v}" for k, v in parts.items())
    return f"with built as ({_FACT_SQL}), freq as ({_frequency_sql('day')}) {union}"


def replay_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """The fact over a landing in which one batch was appended twice: as without the replay."""
    events = table(spark, d, "bronze_device_events")
    again = events.filter(F.col("load_date") == F.lit(LOAD_DATE))
    return models.fact_device_events(events.unionByName(again), *_masters(spark, d))


# ---- the same operators on the star schema


def latest_order(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return latest.latest(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"
    )


def order_status_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a customer's order status, one per day of order."""
    from millrace.operators.neighbours import with_next

    orders = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz"))
    days = latest.latest(orders, ["o_custkey", "at"], [F.col("o_orderkey").desc()]).select("o_custkey", "o_orderstatus", "at")
    return with_next(days, ["o_custkey"], "at", [], {"valid_to": "at"}).withColumnRenamed("at", "valid_from")


def shipments_daily(spark: SparkSession, d: str) -> DataFrame:
    """Shipments per day and supplier with the days since the one before."""
    lines = table(spark, d, "lineitem")
    day = bucket(F.col("l_shipdate").cast("timestamp_ntz"), "day")
    daily = lines.groupBy("l_suppkey", day.alias("ship_day")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    before = F.lag("ship_day").over(Window.partitionBy("l_suppkey").orderBy("ship_day"))
    return daily.withColumn("seconds_since", seconds_between(before, F.col("ship_day")))


def queries() -> dict:
    q = {
        "bronze_events": _bronze_query("bronze_device_events"),
        "bronze_events_load_date": _bronze_query("bronze_device_events", LOAD_DATE),
        "bronze_machines": _bronze_query("bronze_machines"),
        "bronze_event_types": _bronze_query("bronze_event_types"),
        "bronze_error_codes": _bronze_query("bronze_error_codes"),
        "quarantine_rejects": lambda s, d: latest.quarantine(table(s, d, "bronze_device_events"), F.col("machine_id").isNotNull())[1],
        "dedup_latest_events": lambda s, d: models.conformed_events(table(s, d, "bronze_device_events")),
        "silver_fact_events": _built_fact,
        "scd2_machine_status": _built_dim,
        "scd2_current": lambda s, d: _built_dim(s, d).filter("is_current"),
        "scd2_history": lambda s, d: models.status_history(table(s, d, DIM)),
        "error_pairs": _errors,
        "error_open_episodes": lambda s, d: models.open_faults(table(s, d, FACT)),
        "watermark_seed": lambda s, d: models.seed_watermark(*_masters(s, d)),
        "watermark_seed_incremental": lambda s, d: models.seed_watermark(*_masters(s, d), _some_state(s, d)),
        "kpi_mapping": lambda s, d: models.seed_kpi_mapping(*_masters(s, d)),
        "watermark_filter": lambda s, d: frequency.newer_than(table(s, d, FACT), _some_state(s, d)).select("event_id", "event_timestamp"),
        "late_events_dropped": lambda s, d: frequency.late(table(s, d, FACT), _some_state(s, d)).select("event_id", "event_timestamp"),
        "watermark_advance": watermark_advance, "watermark_rewind": watermark_rewind, "watermark_merge": watermark_merge,
        "delete_demo": delete_demo,
        "batch_log_row": batch_log_row,
        "batch_log_empty": lambda s, d: models.empty_batch_log(table(s, d, FACT)),
        "freq_rollup": freq_rollup,
        "dim_machine_status": lambda s, d: models.machine_status(table(s, d, DIM), table(s, d, FACT)),
        "latest_reading_pivot": lambda s, d: models.latest_readings(table(s, d, FACT)),
        "uptime_daily": lambda s, d: models.uptime_daily(table(s, d, DIM), AS_OF),
        "type_performance": lambda s, d: models.type_performance(table(s, d, FACT)),
        "error_analysis": lambda s, d: models.error_analysis(_errors(s, d), table(s, d, DIM)),
        "production_output": lambda s, d: models.production_output(table(s, d, FACT)),
        "day_spine": day_spine, "interval_overlap": interval_overlap, "as_of_status": as_of_status,
        "layer_counts_union": layer_counts, "top_errors": top_errors, "status_having": busy_machines,
        "reading_profile": reading_profile, "status_seconds": status_seconds, "columns_of_fact": columns_of_fact,
        "dq_counts": dq_counts, "dq_metrics": dq_metrics, "replay_idempotent": replay_idempotent,
        "latest_order": latest_order, "order_status_versions": order_status_versions, "shipments_daily": shipments_daily,
    }
    for grain in ("minute", "hour", "day"):
        q[f"freq_{grain}"] = _frequency_query(grain)
        q[f"freq_{grain}_incremental"] = _frequency_query(grain, True)
    return q | {name: query for name, (query, _) in _dq_rows().items()}


def oracle_sql() -> dict[str, str]:
    combos = "(select distinct machine_id, t.event_type_code from bronze_machines cross join bronze_event_types t)"
    epoch = "timestamp '1900-01-01' last_processed_event_timestamp"
    marked = f"{FACT} e left join st using (machine_id, event_type_code)"
    down = ", ".join(f"'{s}'" for s in DOWN)
    until = f"timestamp '{AS_OF}'"
    share = lambda c: f"round(100.0 * {c} / nullif(total_seconds, 0), 2)::double"
    overlap = f"""spans as (
      select *, unnest(generate_series(valid_from::date::timestamp, e - interval 1 microsecond, interval 1 day))::date as day
      from (select *, coalesce(valid_to, {until}) e from {DIM}) where e > valid_from),
    secs as (
      select *, greatest(0, date_diff('second', greatest(valid_from, day::timestamp),
        least(e, day::timestamp + interval 1 day)))::bigint s from spans)"""
    reading = {
        c: f"(select machine_id, event_value v, event_timestamp at from (select *, row_number() over (partition by machine_id "
        f"order by event_timestamp desc, event_id desc) k from {FACT} where event_type_code = '{code}') where k = 1) {n[0]}"
        for (code, (n, c)) in ((code, ((name,), column)) for code, (name, column) in SENSORS.items())
    }
    joins = " ".join(f"left join {sql} on {sql.split()[-1]}.machine_id = base.machine_id" for sql in reading.values())
    latest_columns = ", ".join(
        f"{name}.v latest_{column}, {name}.at latest_{name}_at" for name, column in SENSORS.values()
    ).replace(".at ", '."at" ')
    joins = joins.replace("event_timestamp at from", 'event_timestamp "at" from')
    only = "filter (where event_type_code = '{}')"
    analysis = f"""select m.machine_type, severity, count(*) error_count, avg(resolution_time_seconds) avg_resolution_time_seconds,
      count(*) filter (where requires_maintenance) maintenance_required_count
      from errs join (select distinct machine_id, machine_type from {DIM}) m using (machine_id) group by 1, 2"""
    o = {
        "bronze_events": _bronze_sql("bronze_device_events"),
        "bronze_events_load_date": _bronze_sql("bronze_device_events", f"where load_date = date '{LOAD_DATE}'"),
        "bronze_machines": _bronze_sql("bronze_machines"),
        "bronze_event_types": _bronze_sql("bronze_event_types"),
        "bronze_error_codes": _bronze_sql("bronze_error_codes"),
        "quarantine_rejects": "select * from bronze_device_events where machine_id is null",
        "dedup_latest_events": f"with {_CTE} select * exclude (k) from e",
        "silver_fact_events": _FACT_SQL,
        "replay_idempotent": _FACT_SQL,
        "scd2_machine_status": _DIM_SQL,
        "scd2_current": f"select * from ({_DIM_SQL}) where is_current",
        "scd2_history": f"select * from {DIM}",
        "error_pairs": f"with {_ERRORS} select * from errs",
        "error_open_episodes": f"""with {_ERRORS} select machine_id, error_code, event_timestamp raised_at,
            n_ts raised_again_at from p where event_type_code = 'ERROR_RAISED' and n_type is distinct from 'ERROR_RESOLVED'""",
        "watermark_seed": f"select *, {epoch} from {combos}",
        "watermark_seed_incremental": f"""with {_STATE_SQL} select *, {epoch} from {combos} c where not exists (
            select 1 from st where st.machine_id = c.machine_id and st.event_type_code = c.event_type_code)""",
        "kpi_mapping": f"select *, 'all' kpi_code from {combos}",
        "watermark_filter": f"""with {_STATE_SQL} select event_id, event_timestamp from {marked}
            where event_timestamp > coalesce(last_processed_event_timestamp, timestamp '1900-01-01')""",
        "late_events_dropped": f"""with {_STATE_SQL} select event_id, event_timestamp from {marked}
            where event_timestamp <= last_processed_event_timestamp""",
        "watermark_advance": f"""with {_STATE_SQL} select machine_id, event_type_code,
            coalesce(max(event_timestamp) filter (where event_timestamp > last_processed_event_timestamp),
              last_processed_event_timestamp) last_processed_event_timestamp
            from st left join {FACT} e using (machine_id, event_type_code)
            group by machine_id, event_type_code, last_processed_event_timestamp""",
        "watermark_rewind": f"""with {_STATE_SQL} select machine_id, event_type_code, case when event_type_code = 'STATUS_CHANGE'
            then timestamp '1900-01-01' else last_processed_event_timestamp end last_processed_event_timestamp from st""",
        "watermark_merge": f"""with {_STATE_SQL},
            src as (select distinct machine_id, t.event_type_code from bronze_machines cross join bronze_event_types t
              where machine_type in ('SLICER', 'BAKER') and t.event_type_code <> 'CYCLE_START')
            select *, {epoch} from src union all
            select * from st where (machine_id, event_type_code) not in (select (machine_id, event_type_code) from src)""",
        "delete_demo": """select event_type_code, description from bronze_event_types union all select 'kept-1', 'c'""",
        "batch_log_row": f"""select '{RUN[0]}' batch_run_id, '{RUN[1]}' model_name, count(*) row_count,
            count(distinct machine_id) distinct_machine_count, count(distinct event_type_code) distinct_event_count,
            90::bigint duration_seconds, timestamp '{RUN[2]}' run_started_at, timestamp '{RUN[3]}' run_completed_at
            from ({_frequency_sql("day")})""",
        "batch_log_empty": """select null::varchar batch_run_id, null::varchar model_name, null::bigint row_count,
            null::bigint distinct_machine_count, null::bigint distinct_event_count, null::bigint duration_seconds,
            null::timestamp run_started_at, null::timestamp run_completed_at where false""",
        "freq_rollup": _frequency_sql("day"),
        "dim_machine_status": f"""select base.machine_id, machine_type, status_value, plant_location, firmware_version,
            valid_from status_since, {latest_columns} from (select * from {DIM} where is_current) base {joins}""",
        "latest_reading_pivot": f"""select base.machine_id, {latest_columns} from (select distinct machine_id from {FACT}
            where event_type_code in ({", ".join(f"'{c}'" for c in SENSORS)})) base {joins}""",
        "uptime_daily": f"""with {overlap},
            daily as (select machine_id, machine_type, day event_date, sum(s)::bigint total_seconds,
              coalesce(sum(s) filter (where status_value = 'RUNNING'), 0)::bigint running_seconds,
              coalesce(sum(s) filter (where status_value in ({down})), 0)::bigint down_seconds,
              coalesce(sum(s) filter (where status_value = 'IDLE'), 0)::bigint idle_seconds from secs group by 1, 2, 3)
            select *, {share("running_seconds")} pct_running, {share("down_seconds")} pct_down,
              {share("idle_seconds")} pct_idle from daily""",
        "interval_overlap": f"with {overlap} select machine_sk, day, s overlap_seconds from secs",
        "type_performance": f"""select machine_type, event_date,
            {", ".join(f"avg(event_value) {only.format(code)} avg_{column}" for code, (_, column) in SENSORS.items())},
            {", ".join(f"count(*) {only.format(code)} {name}_reading_count" for code, (name, _) in SENSORS.items())}
            from {FACT} where event_type_code in ({", ".join(f"'{c}'" for c in SENSORS)}) group by 1, 2""",
        "error_analysis": f"with {_ERRORS} {analysis}",
        "top_errors": f"with {_ERRORS} {analysis} order by error_count desc, machine_type, severity limit 6",
        "production_output": f"""select machine_id, machine_type, event_date,
            sum(if(event_type_code = 'PRODUCT_COUNT_UPDATE', product_count, 0))::bigint total_product_count,
            count(*) {only.format("CYCLE_START")} cycle_start_count, count(*) {only.format("CYCLE_COMPLETE")} cycle_complete_count,
            sum(if(event_type_code = 'CYCLE_COMPLETE', product_count, 0))::bigint cycle_product_count,
            avg(cycle_duration_seconds) {only.format("CYCLE_COMPLETE")} avg_cycle_duration_seconds
            from {FACT} group by 1, 2, 3""",
        "day_spine": f"""select unnest(generate_series(a, b, interval 1 day))::date as day from (
            select min(valid_from)::date::timestamp a, max(coalesce(valid_to, valid_from))::date::timestamp b from {DIM})""",
        "as_of_status": f"""select e.event_id, e.machine_id, event_timestamp, load_date, source_ingested_at, d.status_value,
            d.firmware_version, valid_from, valid_to from bronze_device_events e left join {DIM} d
            on d.machine_id = e.machine_id and event_timestamp >= valid_from
            and (valid_to is null or event_timestamp < valid_to)""",
        "layer_counts_union": " union all ".join(
            f"select '{n}' object, count(*) n_rows from {n}"
            for n in ("bronze_device_events", "bronze_machines", FACT, DIM, "machine_snapshots")
        ),
        "status_having": f"select machine_id, count(*) n_versions from {DIM} group by 1 having count(*) > 3",
        "reading_profile": f"""select event_type_code, count(*) n_rows, count(event_value) n_values,
            round(min(event_value), 2) least, round(max(event_value), 2) greatest, count(distinct machine_id) n_machines,
            (select count(*) from {FACT}) n_total from {FACT} group by 1""",
        "status_seconds": f"""select status_value, sum(s)::bigint total_seconds from (
            select status_value, date_diff('second', valid_from, valid_to) s from {DIM}) group by 1""",
        # The types' names differ between the two: those of this table are translated.
        "columns_of_fact": f"""select column_name, case data_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint'
            when 'DOUBLE' then 'double' when 'DATE' then 'date' when 'TIMESTAMP' then 'timestamp_ntz' else data_type end data_type,
            ordinal_position::bigint ordinal_position from information_schema.columns where table_name = '{FACT}'""",
        "dq_counts": _dq_sql(),
        "dq_metrics": """select sum(n)::bigint row_count, count(*) filter (where n > 1 and event_id is not null) duplicate_count,
            sum(m)::bigint missing_count from (select event_id, count(*) n, count(*) filter (where machine_id is null) m
            from bronze_device_events group by 1)""",
        "latest_order": """select o_custkey, o_orderkey, o_orderdate, o_orderstatus from (select *, row_number() over (
            partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders) where k = 1""",
        "order_status_versions": """select o_custkey, o_orderstatus, o_orderdate::timestamp valid_from,
            lead(o_orderdate::timestamp) over (partition by o_custkey order by o_orderdate) valid_to from (
            select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) k from orders) where k = 1""",
        "shipments_daily": """select l_suppkey, ship_day, n_lines, quantity, date_diff('second', lag(ship_day) over (
            partition by l_suppkey order by ship_day), ship_day) seconds_since from (select l_suppkey,
            date_trunc('day', l_shipdate)::timestamp ship_day, count(*) n_lines, sum(l_quantity) quantity
            from lineitem group by 1, 2)""",
    }
    for grain in ("minute", "hour", "day"):
        o[f"freq_{grain}"] = _frequency_sql(grain)
        o[f"freq_{grain}_incremental"] = _frequency_sql(grain, True)
    return o | {name: sql for name, (_, sql) in _dq_rows().items()}
