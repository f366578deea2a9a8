"""Queries p1 to p5 over the telemetry tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import dashed, hex_identity, reference, stripped
from millrace.functions.temporal import day_text, micros
from millrace.operators import delivery, history, late, orphans, sessions
from millrace.session import table

GAP_S = 30 * 60
CUTOFF_DAYS = 3
FIELDS = ["status_value", "firmware_version"]


# ---- p1: history of machine attributes


def _observations(spark: SparkSession, d: str) -> DataFrame:
    status = F.nullif(F.upper(stripped(F.col("status_value"))), F.lit(""))
    firmware = F.nullif(F.lower(stripped(F.col("firmware_version"))), F.lit(""))
    dim = table(spark, d, "silver_dim_machines").select(
        "machine_id", micros(F.col("valid_from")).alias("valid_us"),
        F.lit(history.BEFORE_ALL).alias("recorded_us"), F.lit(0).cast("bigint").alias("seq"),
        status.alias("status_value"), firmware.alias("firmware_version"),
    )
    snapshots = table(spark, d, "machine_snapshots").filter(F.col("snapshot_at") <= F.col("received_at")).select(
        "machine_id", micros(F.col("snapshot_at")).alias("valid_us"),
        micros(F.col("received_at")).alias("recorded_us"), F.col("snapshot_no").alias("seq"),
        status.alias("status_value"), firmware.alias("firmware_version"),
    )
    return dim.unionByName(snapshots).filter(stripped(F.col("machine_id")) != "")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return history.ledger(_observations(spark, d), "machine_id", "valid_us", "recorded_us", "seq", FIELDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.versions(_ledger(spark, d), FIELDS).select(
        F.col("entity").alias("machine_id"), "valid_from_us",
        F.coalesce("valid_to_us", F.lit(0)).cast("bigint").alias("valid_to_us"),
    )


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The versions with their values."""
    return history.versions(_ledger(spark, d), FIELDS).select(
        F.col("entity").alias("machine_id"), *FIELDS, "valid_from_us", "valid_to_us"
    )


#: The recorded time at which p1_as_known reads the ledger: 2019-01-20.
AS_KNOWN_US = 1_547_942_400_000_000


def p1_as_known(spark: SparkSession, d: str) -> DataFrame:
    """The history as the ledger told it on 2019-01-20, before later corrections."""
    return history.versions(_ledger(spark, d), FIELDS, AS_KNOWN_US).select(
        F.col("entity").alias("machine_id"), *FIELDS, "valid_from_us", "valid_to_us"
    )


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger itself: of each field every row, those superseded by later knowledge included."""
    return _ledger(spark, d).withColumnRenamed("entity", "machine_id")


_OBSERVED_SQL = f"""
with obs as (
  select machine_id, epoch_us(valid_from) v, {history.BEFORE_ALL} r, 0 s,
    nullif(upper(trim(status_value)), '') a, nullif(lower(trim(firmware_version)), '') b from silver_dim_machines
  union all
  select machine_id, epoch_us(snapshot_at), epoch_us(received_at), snapshot_no,
    nullif(upper(trim(status_value)), ''), nullif(lower(trim(firmware_version)), '')
  from machine_snapshots where snapshot_at <= received_at)"""


def _p1_sql(columns: str, known: str = "true") -> str:
    return f"""{_OBSERVED_SQL},
told as (select * from obs where trim(machine_id) <> '' and {known}),
inst as (
  select machine_id, v, arg_max(a, (r, s)) filter (where a is not null) a,
    arg_max(b, (r, s)) filter (where b is not null) b from told group by 1, 2),
filled as (
  select machine_id, v,
    last_value(a ignore nulls) over (partition by machine_id order by v rows unbounded preceding) a,
    last_value(b ignore nulls) over (partition by machine_id order by v rows unbounded preceding) b from inst),
prev as (
  select *, lag(a) over (partition by machine_id order by v) pa, lag(b) over (partition by machine_id order by v) pb
  from filled),
begun as (select * from prev where a is distinct from pa or b is distinct from pb)
select {columns} from (
  select machine_id, a status_value, b firmware_version, v valid_from_us,
    lead(v) over (partition by machine_id order by v) valid_to_us from begun)"""


#: By definition: what holds at a start changes when it is told again and when a start behind it comes nearer.
_P1_LEDGER_SQL = f"""{_OBSERVED_SQL},
told as (
  select machine_id, 'status_value' field, v, r, arg_max(a, (s, a)) x from obs where a is not null and trim(machine_id) <> '' group by 1, 2, 3, 4 union all
  select machine_id, 'firmware_version', v, r, arg_max(b, (s, b)) from obs where b is not null and trim(machine_id) <> '' group by 1, 2, 3, 4),
starts as (select machine_id, field, v, min(r) known from told group by 1, 2, 3),
changes as (
  select machine_id, field, v, r from told union
  select a.machine_id, a.field, a.v, greatest(a.known, b.known) from starts a join starts b
    on b.machine_id = a.machine_id and b.field = a.field and b.v > a.v),
states as (
  select c.machine_id, c.field, c.v, c.r, arg_max(t.x, t.r) x, min(b.v) e from changes c
  join told t on t.machine_id = c.machine_id and t.field = c.field and t.v = c.v and t.r <= c.r
  left join starts b on b.machine_id = c.machine_id and b.field = c.field and b.v > c.v and b.known <= c.r
  group by 1, 2, 3, 4),
marked as (
  select *, row_number() over w = 1 or x is distinct from lag(x) over w or e is distinct from lag(e) over w other
  from states window w as (partition by machine_id, field, v order by r))
select machine_id, field, x as "value", v valid_from_us, e valid_to_us, r recorded_from_us,
  lead(r) over (partition by machine_id, field, v order by r) recorded_to_us from marked where other"""


# ---- p2: late events


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "bronze_device_events")
    return late.corrected_periods(
        events, hex_identity(F.col("event_id")), reference(F.col("machine_id")), F.col("event_timestamp"),
        F.col("source_ingested_at"), F.col("load_date"), F.col("product_count"), F.col("temperature_c"), CUTOFF_DAYS,
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _corrected(spark, d).filter(F.col("revision") > 0).select(
        F.col("key").alias("machine_id"), day_text(F.col("event_day")).alias("event_day"),
        day_text(F.col("load_day")).alias("load_day"),
    )


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """The figures of each machine and day after every load that changed them."""
    return _corrected(spark, d).select(
        F.col("key").alias("machine_id"), "event_day", "load_day", F.col("revision").cast("bigint").alias("revision"),
        "event_count", F.col("total").alias("product_count"), F.col("least").alias("min_temperature_c"),
        F.col("most").alias("max_temperature_c"),
    )


_HEX = "right(regexp_replace(lower(event_id), '[^0-9a-f]', '', 'g'), 32)"
_ONCE_SQL = f"""
with rows as (
  select {_HEX} id, upper(trim(machine_id)) machine_id, event_timestamp ts, source_ingested_at seen, load_date,
    product_count, temperature_c
  from bronze_device_events where trim(machine_id) <> '' and event_timestamp <= source_ingested_at),
once as (
  select * from (select *, row_number() over (
    partition by id order by load_date, seen, machine_id, ts, product_count nulls first, temperature_c nulls first) k
  from rows) where k = 1),
counted as (
  select *, ts::date event_day from once where load_date - ts::date <= {CUTOFF_DAYS}),
loads as (
  select machine_id, event_day, load_date, count(*) n, coalesce(sum(product_count), 0) p, min(temperature_c) lo,
    max(temperature_c) hi from counted group by 1, 2, 3),
played as (
  select machine_id, event_day, load_date load_day, row_number() over w - 1 revision, sum(n) over w event_count,
    sum(p) over w product_count, min(lo) over w min_temperature_c, max(hi) over w max_temperature_c
  from loads window w as (partition by machine_id, event_day order by load_date rows unbounded preceding))"""


# ---- p3: sessions


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.sessions(table(spark, d, "silver_fact_device_events"), ["machine_id"], "event_timestamp", GAP_S)
    return found.select(
        "machine_id", micros(F.col("session_start")).alias("start_us"), micros(F.col("session_end")).alias("end_us")
    )


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(table(spark, d, "silver_fact_device_events"), ["machine_id"], "event_timestamp", GAP_S)


def p3_types(spark: SparkSession, d: str) -> DataFrame:
    """Events per session and event_type_code."""
    return sessions.session_kinds(
        table(spark, d, "silver_fact_device_events"), ["machine_id"], "event_timestamp", "event_type_code", GAP_S
    )


_SESSION_SQL = f"""
with gaps as (
  select *, case when event_timestamp - lag(event_timestamp) over w > interval {GAP_S} second then 1 else 0 end flag
  from silver_fact_device_events where machine_id is not null and event_timestamp is not null
  window w as (partition by machine_id order by event_timestamp)),
numbered as (
  select *, sum(flag) over (partition by machine_id order by event_timestamp range unbounded preceding) no
  from gaps)"""


# ---- p4: messages delivered more than once


#: What breaks ties between copies after the order of ``_order`` and the stamp of the landing, ascending, nulls first.
_REST = (
    "event_id machine_id event_type_code machine_type event_timestamp event_date status_value temperature_c speed_units_per_min "
    "vibration_mm_s product_count cycle_duration_seconds error_code"
).split()


def _order() -> list[Column]:
    named = reference(F.col("machine_id")).isNotNull()
    return [named.desc(), F.col("source_ingested_at").desc(), F.col("load_date").desc()]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "bronze_device_events").select("event_id", "machine_id", "source_ingested_at", "load_date")
    kept = delivery.ranked_repeats(events, hex_identity(F.col("event_id")), _order())
    return kept.select(
        dashed(F.col(delivery.ID)).alias("event_id"), micros(F.col("source_ingested_at")).alias("kept_ingested_us"),
        day_text(F.col("load_date")).alias("kept_load_day"),
    )


def p4_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    """Every message once, whole rows; all columns are in the order, so copies that tie are the same row."""
    events = table(spark, d, "bronze_device_events")
    order = [*_order(), F.col("_loaded_at").desc(), *[F.col(c) for c in _REST if c in events.columns]]
    kept = delivery.exactly_once(events, hex_identity(F.col("event_id")), order)
    return kept.select(
        dashed(F.col(delivery.ID)).alias("message_id"), F.col(delivery.N).alias("copies"), *events.columns
    )


_P4_ORDER = "(coalesce(trim(machine_id), '') <> '') desc, source_ingested_at desc, load_date desc"
_DASHED = (
    "regexp_replace(id, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
)

# ---- p5: orphans

MACHINES, ERRORS, TYPES = "bronze_machines", "bronze_error_codes", "bronze_event_types"
_KEYS = {MACHINES: "machine_id", ERRORS: "error_code", TYPES: "event_type_code"}


_EVENTS = "bronze_device_events"


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Periods in which the keys of the master tables are known, by their loads and removals."""
    removed = table(spark, d, "master_removals")
    known = None
    for name, key in _KEYS.items():
        loads = table(spark, d, name).select(reference(F.col(key)).alias("ref_value"), F.to_date("_loaded_at").alias("day"))
        gone = removed.filter(F.col("ref_table") == name).select(
            reference(F.col("ref_key")).alias("ref_value"), F.col("removed_on").alias("day")
        )
        part = orphans.known_periods(loads, gone).withColumn("parent_table", F.lit(name))
        known = part if known is None else known.unionByName(part)
    return known


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    graph = [orphans.ForeignKey(_EVENTS, key, name, key) for name, key in _KEYS.items()]
    found = orphans.orphans({_EVENTS: table(spark, d, _EVENTS)}, graph, F.col("load_date"), _known(spark, d))
    return found.filter("kind = 'direct'").select(
        F.col("parent_table").alias("ref_table"), "ref_value", day_text(F.col("day")).alias("load_day")
    )


def p5_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orphans down the graph: snapshots and events name machine versions, and those name machines.

    Keys are known in periods, by loads and removals as in ``p5_found``; a version is known from its first
    day on. A snapshot or event on a day on which the master does not know the machine of its version
    is inherited from the version, orphaned that day.
    """
    tables = {
        MACHINES: table(spark, d, MACHINES), ERRORS: table(spark, d, ERRORS),
        "silver_dim_machines": table(spark, d, "silver_dim_machines").withColumn("day", F.to_date("valid_from")),
        "machine_snapshots": table(spark, d, "machine_snapshots").withColumn("day", F.to_date("received_at")),
        _EVENTS: table(spark, d, _EVENTS).withColumn("day", F.col("load_date")),
    }
    fk = orphans.ForeignKey
    graph = [
        fk("silver_dim_machines", "machine_id", MACHINES, "machine_id"),
        fk("machine_snapshots", "machine_id", "silver_dim_machines", "machine_id"),
        fk(_EVENTS, "machine_id", "silver_dim_machines", "machine_id"),
        fk(_EVENTS, "error_code", ERRORS, "error_code"),
        fk(_EVENTS, "event_type_code", TYPES, "event_type_code"),
    ]
    begun = tables["silver_dim_machines"].select(reference(F.col("machine_id")).alias("ref_value"), "day")
    versions = orphans.known_periods(begun).withColumn("parent_table", F.lit("silver_dim_machines"))
    found = orphans.orphans(tables, graph, F.col("day"), _known(spark, d).unionByName(versions))
    return found.select(
        "child_table", "parent_table", "ref_value", F.col("day").alias("period"), "kind",
        F.col("depth").cast("bigint").alias("depth"), "record_count",
    )


_P5_SQL = """
with refs as (
  select distinct t ref_table, upper(trim(v)) ref_value, load_date from (
    select 'bronze_machines' t, machine_id v, load_date from bronze_device_events union all
    select 'bronze_error_codes', error_code, load_date from bronze_device_events union all
    select 'bronze_event_types', event_type_code, load_date from bronze_device_events) where trim(v) <> ''),
loads as (
  select distinct t ref_table, upper(trim(v)) ref_value, seen::date loaded from (
    select 'bronze_machines' t, machine_id v, _loaded_at seen from bronze_machines union all
    select 'bronze_error_codes', error_code, _loaded_at from bronze_error_codes union all
    select 'bronze_event_types', event_type_code, _loaded_at from bronze_event_types)),
gone as (select ref_table, upper(trim(ref_key)) ref_value, removed_on from master_removals)
select ref_table, ref_value, strftime(load_date, '%Y-%m-%d') load_day from refs r where not exists (
  select 1 from loads l where l.ref_table = r.ref_table and l.ref_value = r.ref_value and l.loaded <= r.load_date
    and not exists (select 1 from gone g where g.ref_table = r.ref_table and g.ref_value = r.ref_value
      and g.removed_on <= r.load_date and g.removed_on >= l.loaded))"""

_P5_CASCADE_SQL = """
with refs as (
  select child_table, parent_table, upper(trim(v)) k, d, count(*) n from (
    select 'silver_dim_machines' child_table, 'bronze_machines' parent_table, machine_id v, valid_from::date d from silver_dim_machines union all
    select 'machine_snapshots', 'silver_dim_machines', machine_id, received_at::date from machine_snapshots union all
    select 'bronze_device_events', 'silver_dim_machines', machine_id, load_date from bronze_device_events union all
    select 'bronze_device_events', 'bronze_error_codes', error_code, load_date from bronze_device_events union all
    select 'bronze_device_events', 'bronze_event_types', event_type_code, load_date from bronze_device_events)
  where trim(v) <> '' and d is not null group by all),
loads as (
  select distinct t master, upper(trim(v)) k, seen::date loaded from (
    select 'bronze_machines' t, machine_id v, _loaded_at seen from bronze_machines union all
    select 'bronze_error_codes', error_code, _loaded_at from bronze_error_codes union all
    select 'bronze_event_types', event_type_code, _loaded_at from bronze_event_types)),
gone as (select ref_table master, upper(trim(ref_key)) k, removed_on from master_removals),
begun as (select upper(trim(machine_id)) k, min(valid_from::date) since from silver_dim_machines group by 1),
asked as (
  select r.*, parent_table = 'silver_dim_machines' through, coalesce(since <= d, false) held,
    case when parent_table = 'silver_dim_machines' then 'bronze_machines' else parent_table end master
  from refs r left join begun b on b.k = r.k),
judged as (
  select *, exists (select 1 from loads l where l.master = a.master and l.k = a.k and l.loaded <= a.d
    and not exists (select 1 from gone g where g.master = a.master and g.k = a.k and g.removed_on <= a.d
      and g.removed_on >= l.loaded)) known from asked a)
select child_table, parent_table, k ref_value, d period, case when through and held then 'inherited' else 'direct' end kind,
  case when through and held then 1 else 0 end::bigint depth, n record_count
from judged where not known or through and not held"""


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_history": p1_history, "p1_as_known": p1_as_known, "p1_ledger": p1_ledger,
        "p2_found": p2_found, "p2_daily": p2_daily,
        "p3_found": p3_found, "p3_sessions": p3_sessions, "p3_types": p3_types,
        "p4_found": p4_found, "p4_exactly_once": p4_exactly_once,
        "p5_found": p5_found, "p5_cascade": p5_cascade,
    }


def oracle_sql() -> dict[str, str]:
    whole = "machine_id, status_value, firmware_version, valid_from_us, valid_to_us"
    return {
        "p1_found": _p1_sql("machine_id, valid_from_us, coalesce(valid_to_us, 0) valid_to_us"),
        "p1_history": _p1_sql(whole),
        "p1_as_known": _p1_sql(whole, f"r <= {AS_KNOWN_US}"),
        "p1_ledger": _P1_LEDGER_SQL,
        "p2_found": _ONCE_SQL
        + """ select machine_id, strftime(event_day, '%Y-%m-%d') event_day, strftime(load_day, '%Y-%m-%d') load_day
        from played where revision > 0""",
        "p2_daily": _ONCE_SQL
        + """ select machine_id, event_day, load_day, revision::bigint revision, event_count::bigint event_count,
        product_count::bigint product_count, min_temperature_c, max_temperature_c from played""",
        "p3_found": _SESSION_SQL
        + """ select machine_id, epoch_us(min(event_timestamp)) start_us, epoch_us(max(event_timestamp)) end_us
        from numbered group by machine_id, no""",
        "p3_sessions": _SESSION_SQL
        + """ select machine_id, (no + 1)::bigint session_no, min(event_timestamp) session_start,
        max(event_timestamp) session_end,
        (epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp))) / 1000000 duration_seconds,
        count(*) event_count from numbered group by machine_id, no""",
        "p3_types": _SESSION_SQL
        + """ select machine_id, (no + 1)::bigint session_no, min(min(event_timestamp)) over s session_start,
        max(max(event_timestamp)) over s session_end, event_type_code, count(*) kind_count
        from numbered group by machine_id, no, event_type_code window s as (partition by machine_id, no)""",
        "p4_found": f"""
        with n as (select *, {_HEX} id from bronze_device_events),
        r as (select *, count(*) over (partition by id) copies,
          row_number() over (partition by id order by {_P4_ORDER}) k from n)
        select {_DASHED} event_id, epoch_us(source_ingested_at) kept_ingested_us,
          strftime(load_date, '%Y-%m-%d') kept_load_day from r where copies > 1 and k = 1""",
        "p4_exactly_once": f"""
        with n as (select *, {_HEX} id from bronze_device_events),
        r as (select *, count(*) over (partition by id) copies,
          row_number() over (partition by id order by {_P4_ORDER}, _loaded_at desc,
          {", ".join(f"{c} nulls first" for c in _REST)}) k from n)
        select {_DASHED} message_id, copies, * exclude (id, k, copies) from r where k = 1""",
        "p5_found": _P5_SQL,
        "p5_cascade": _P5_CASCADE_SQL,
    }
