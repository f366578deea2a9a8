"""Registry, selection and running of models: a dependency graph from raw tables to reports."""

from __future__ import annotations

import datetime as dt
import fnmatch
import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import quality
from millrace.operators import frequency, models
from millrace.schemas import BATCH_LOG, BRONZE, CATEGORIES, KPI_MAPPING, MACHINE_TYPES, READINGS, SEVERITIES, STATUSES, WATERMARK
from millrace.sources import files
from millrace.sources.state import StateTable, upsert

LAYERS = ("raw", "bronze", "silver", "gold")
#: Materialization of a layer unless the model names its own.
DEFAULTS = {"bronze": "append", "silver": "table", "gold": "view"}
#: Namespace of a layer unless the model names its own.
NAMESPACES = {"raw": "raw", "bronze": "bronze", "silver": "silver", "gold": "gold"}


@dataclass(frozen=True)
class Model:
    """A node: ``build`` makes its DataFrame from the context."""

    name: str
    layer: str
    deps: tuple[str, ...]
    build: Callable[[Context], DataFrame]
    materialized: str
    tags: frozenset[str] = frozenset()
    checks: dict = field(default_factory=dict)
    schema: str | None = None

    @property
    def namespace(self) -> str:
        """The folder of the model's table: its own schema as it is named, else that of its layer."""
        return NAMESPACES[self.layer] if self.schema is None else self.schema.strip()

    @property
    def fingerprint(self) -> str:
        """Changes when the model's source does."""
        return hashlib.sha256(inspect.getsource(self.build).encode()).hexdigest()


class Registry:
    """Models by name. A model may refer only to earlier layers or its own; gold only to silver and gold."""

    def __init__(self) -> None:
        self.models: dict[str, Model] = {}

    def model(self, layer: str, deps: list[str] = (), materialized: str | None = None, tags: list[str] = (), checks: dict | None = None, schema: str | None = None):
        def add(build):
            m = Model(build.__name__, layer, tuple(deps), build, materialized or DEFAULTS[layer], frozenset([layer, *tags]), checks or {}, schema)
            for dep in m.deps:
                below = "raw" if dep.startswith("raw_") else self.models[dep].layer
                if LAYERS.index(below) > LAYERS.index(layer) or layer == "gold" and below not in ("silver", "gold"):
                    raise ValueError(f"{m.name} ({layer}) must not refer to {dep} ({below})")
            self.models[m.name] = m
            return build

        return add

    def order(self, names: set[str] | None = None) -> list[str]:
        """Names in an order in which each follows what it depends on."""
        done: dict[str, bool] = {}

        def visit(name: str) -> None:
            if name in done or name not in self.models:
                if done.get(name) is False:
                    raise ValueError(f"{name} depends on itself")
                return
            done[name] = False
            for dep in self.models[name].deps:
                visit(dep)
            done[name] = True

        for name in self.models:
            visit(name)
        return [n for n in done if names is None or n in names]

    def _closure(self, start: str, up: bool) -> set[str]:
        found, todo = set(), [start]
        while todo:
            at = todo.pop()
            near = self.models[at].deps if up else [m.name for m in self.models.values() if at in m.deps]
            for n in near:
                if n in self.models and n not in found:
                    found.add(n)
                    todo.append(n)
        return found

    def select(self, expression: str = "", previous: dict[str, str] | None = None) -> set[str]:
        """Names that a selection means: parts by blanks, each a name, pattern, ``layer.*`` or ``tag:x``,
        ``state:modified`` (against ``previous`` fingerprints), with + before for ancestors, after for descendants."""
        if not expression.strip():
            return set(self.models)
        out: set[str] = set()
        for part in expression.split():
            up, down, core = part.startswith("+"), part.endswith("+"), part.strip("+")
            if core.startswith("tag:"):
                base = {m.name for m in self.models.values() if core[4:] in m.tags}
            elif core == "state:modified":
                base = {m.name for m in self.models.values() if (previous or {}).get(m.name) != m.fingerprint}
            elif core.endswith(".*"):
                base = {m.name for m in self.models.values() if m.layer == core[:-2]}
            else:
                base = {n for n in self.models if fnmatch.fnmatch(n, core)}
            if not base:
                raise ValueError(f"nothing is named by {part!r}")
            for name in base:
                out |= {name} | (self._closure(name, True) if up else set()) | (self._closure(name, False) if down else set())
        return out

    def lineage(self) -> str:
        """Nodes and edges as JSON."""
        nodes = {
            n: {"layer": m.layer, "depends_on": list(m.deps), "materialized": m.materialized, "tags": sorted(m.tags), "fingerprint": m.fingerprint}
            for n, m in self.models.items()
        }
        return json.dumps(nodes, indent=2, sort_keys=True)

    def state(self) -> dict[str, str]:
        return {n: m.fingerprint for n, m in self.models.items()}


@dataclass
class Context:
    """What a model sees while it is built: tables before it, state tables and variables."""

    spark: SparkSession
    root: str
    raw: dict[str, DataFrame]
    vars: dict = field(default_factory=dict)
    full_refresh: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
    views: dict[str, DataFrame] = field(default_factory=dict)

    registry: Registry | None = None

    def path(self, name: str) -> str:
        """Folder of a table: in its namespace, or where it lies already beside the namespaces, or is no model."""
        model = (self.registry or telemetry).models.get(name)
        beside = f"{self.root}/{name}"
        namespace = model.namespace if model else NAMESPACES["raw"] if name in files.RAW else None
        return beside if namespace is None or files.exists(self.spark, beside) else f"{self.root}/{namespace}/{name}"

    def raw_tables(self) -> dict[str, DataFrame]:
        """The raw tables that are given, or else stored by ``seed``."""
        stored = [n for n in files.RAW if n not in self.raw and files.exists(self.spark, self.path(n))]
        return self.raw | {n: self.spark.read.parquet(self.path(n)) for n in stored}

    def tables(self) -> DataFrame:
        """Namespace and name of each table that is stored."""
        own = {m.namespace for m in (self.registry or telemetry).models.values()}
        return files.tables(self.spark, self.root, tuple(sorted({*NAMESPACES.values(), *own})))

    def ref(self, name: str) -> DataFrame:
        if name in self.raw:
            return self.raw[name]
        if name in self.views:
            return self.views[name]
        if name in STATES:
            return self.state(name).read()
        return self.spark.read.parquet(self.path(name))

    def state(self, name: str) -> StateTable:
        return StateTable(self.spark, self.path(name), STATES[name])


STATES = {
    "silver_tec_watermark": T.StructType([*WATERMARK.fields, T.StructField("model_name", T.StringType())]),
    "silver_tec_kpi_mapping": KPI_MAPPING,
    "silver_tec_batch_execution_log": BATCH_LOG,
}


@dataclass(frozen=True)
class Outcome:
    model: str
    status: str  # PASS, ERROR, FAIL (a check failed) or SKIP
    detail: str = ""
    checks: tuple[quality.Result, ...] = ()


#: State tables have one writer at a time in a process; across processes StaleVersion tells.
_WRITER = Lock()


def _materialize(ctx: Context, m: Model, df: DataFrame) -> None:
    if m.materialized == "view":
        ctx.views[m.name] = df
        df.createOrReplaceTempView(m.name)
    elif m.materialized == "append":
        if ctx.full_refresh:
            files.overwrite(df, ctx.path(m.name))
        else:
            files.append(df, ctx.path(m.name), BRONZE.get(m.name))
    elif m.materialized == "table":
        files.overwrite(df, ctx.path(m.name))
    elif m.materialized == "state":
        with _WRITER:
            table = ctx.state(m.name)
            base = table.version()
            old = table.read(0) if ctx.full_refresh else table.read(base)
            table.commit(old.unionByName(df, allowMissingColumns=True), base)
    else:
        raise ValueError(m.materialized)


def run(
    registry: Registry, ctx: Context, select: str = "", test: bool = True, previous: dict[str, str] | None = None, threads: int = 1
) -> list[Outcome]:
    """Builds the selected models in order, each followed by its checks; up to ``threads`` at a time.

    With ``test``, the raw tables that selected models read are checked before anything is built. What depends on
    a raw table or model that broke off or failed a check is skipped.
    """
    ctx.registry = ctx.registry or registry
    order = registry.order(registry.select(select, previous))
    done: dict[str, Outcome] = {}
    asked = {d for n in order for d in registry.models[n].deps} if test else set()
    results = test_sources(ctx, asked) if asked & set(SOURCE_CHECKS) else []
    sources = [
        Outcome(n, "FAIL" if quality.exit_code(own) else "PASS", checks=tuple(own))
        for n in dict.fromkeys(r.table for r in results) for own in [[r for r in results if r.table == n]]
    ]
    unsound = {o.model for o in sources if o.status != "PASS"}
    with ThreadPoolExecutor(threads) as pool:
        while len(done) < len(order):
            ready = [n for n in order if n not in done and all(d in done or d not in order for d in registry.models[n].deps)]
            bad = unsound | {n for n, o in done.items() if o.status != "PASS"}
            done |= zip(ready, pool.map(lambda n: _one(registry, ctx, n, bad, test), ready))
    return [*sources, *(done[n] for n in order)]


def seed(ctx: Context) -> list[str]:
    """Stores the given raw tables, so that later runs read them without parsing them again; returns their names."""
    for name, df in ctx.raw.items():
        files.overwrite(df, ctx.path(name))
    return list(ctx.raw)


def _one(registry: Registry, ctx: Context, name: str, bad: set[str], test: bool) -> Outcome:
    m = registry.models[name]
    if bad & set(m.deps):
        return Outcome(name, "SKIP", f"after {', '.join(sorted(bad & set(m.deps)))}")
    try:
        _materialize(ctx, m, m.build(ctx))
        results: list[quality.Result] = []
        if test and m.checks:
            needed = {name, *(p for _, p, _ in m.checks.get("relationships", []))}
            results = quality.run(quality.parse(name, m.checks), {n: ctx.ref(n) for n in needed})
        if name in FREQUENCY:
            commit_batch(ctx, name, ctx.views[name])
    except Exception as error:  # the report carries it
        return Outcome(name, "ERROR", str(error)[:500])
    return Outcome(name, "FAIL" if quality.exit_code(results) else "PASS", checks=tuple(results))


def commit_batch(ctx: Context, model: str, output: DataFrame) -> None:
    """After a frequency model: first its row in the batch log, then its marks.

    Marks are kept per model, so models do not advance each other's. A crash between the two leaves
    a log row that the rerun replaces, as it is keyed by run and model.
    """
    output = output.persist()
    try:
        with _WRITER:
            row = models.batch_log_row(output, ctx.run_id, model, ctx.started, dt.datetime.now(dt.UTC).replace(tzinfo=None))
            ctx.state("silver_tec_batch_execution_log").change(lambda s: upsert(s, row, ["batch_run_id", "model_name"]))

            def advanced(s: DataFrame) -> DataFrame:
                own, other = s.filter(s.model_name == model), s.filter(s.model_name != model)
                return other.unionByName(frequency.advance(own, output))

            ctx.state("silver_tec_watermark").change(advanced)
    finally:
        output.unpersist()


#: Checks of the raw tables before anything is built on them.
SOURCE_CHECKS = {
    "raw_machines": {"unique": ["machine_id"], "not_null": ["machine_id"], "accepted_values": [("machine_type", MACHINE_TYPES)]},
    "raw_event_types": {"unique": ["event_type_code"], "not_null": ["event_type_code"], "accepted_values": [("event_category", CATEGORIES)]},
    "raw_error_codes": {"unique": ["error_code"], "not_null": ["error_code"], "accepted_values": [("severity", SEVERITIES)]},
    "raw_device_events": {
        "not_null": ["event_id", "event_type_code", "event_timestamp", "load_date"], "accepted_values": [("status_value", STATUSES)],
        "relationships": [("event_type_code", "raw_event_types", "event_type_code")],
    },
}


def test_sources(ctx: Context, names: set[str] | None = None) -> list[quality.Result]:
    """The checks of the raw tables that are given or stored; of ``names`` only, if given."""
    raw = ctx.raw_tables()
    checks = [
        c for name, spec in SOURCE_CHECKS.items() if name in raw and (names is None or name in names) for c in quality.parse(name, spec)
    ]
    return quality.run(checks, raw)


def scan(ctx: Context, first_day: dt.date, last_day: dt.date) -> list[quality.Result]:
    """An independent scan of the built tables for data of the loads from ``first_day`` to ``last_day``."""
    within = lambda c: lambda: ~F.to_date(F.col(c)).between(F.lit(first_day), F.lit(last_day))
    fact, dim, bronze = "silver_fact_device_events", "silver_dim_machines", "bronze_device_events"
    row, query = (lambda n, t, v: quality.Check(n, t, verdict=v)), quality.Check
    checks = [
        *quality.parse(dim, {"min_rows": 1, "unique": ["machine_sk"], "singular": [quality.scd2_overlap, quality.one_current]}),
        row("valid_from in the window", dim, within("valid_from")),
        *quality.parse(fact, {"min_rows": 1, "unique": ["event_id"], "not_null": ["machine_id"]}),
        query("every sound event survives", fact, lambda t: quality.lost_events(t[bronze], t[fact])),
        query("the latest delivery is kept", fact, lambda t: quality.older_copy_kept(t[bronze], t[fact])),
        row("load_date in the window", fact, within("load_date")),
        row("readings have a value", fact, lambda: F.col("event_type_code").isin(*READINGS) & F.col("event_value").isNull()),
        row("no event of the future", fact, lambda: F.col("event_timestamp") > F.lit(ctx.started)),
    ]
    # Taken over the whole fact: behind their own marks the frequency views are empty, and prove nothing.
    tables = {n: ctx.ref(n) for n in (fact, dim, bronze)}
    for name, grain in FREQUENCY.items():
        tables[name] = frequency.event_frequency(tables[fact], grain)
        checks += [
            row("event_count is positive", name, lambda: F.col("event_count") < 1),
            row("a gap wherever there are two events", name, lambda: F.col("avg_seconds_between_events").isNull() & (F.col("event_count") > 1)),
            row("bucket_start in the window", name, within("bucket_start")),
        ]
    return quality.run(checks, tables)


# ---- the telemetry pipeline

telemetry = Registry()
FREQUENCY = {f"agg_event_frequency_{grain}": grain for grain in ("minute", "hour", "day")}
_SCD2_CHECKS = {"unique": ["machine_sk"], "not_null": ["machine_sk", "machine_id", "valid_from"]}


def _bronze(name: str, checks: dict) -> None:
    def build(ctx: Context) -> DataFrame:
        load_date = ctx.vars.get("load_date") if name == "bronze_device_events" else None
        return models.bronze(ctx.ref(name.replace("bronze_", "raw_")), name, ctx.started, load_date)

    build.__name__ = name
    telemetry.model("bronze", [name.replace("bronze_", "raw_")], checks=checks)(build)


_bronze("bronze_machines", {"not_null": ["machine_id", "_loaded_at"], "accepted_values": [("machine_type", MACHINE_TYPES)]})
_bronze("bronze_event_types", {"not_null": ["event_type_code", "_loaded_at"], "accepted_values": [("event_category", CATEGORIES)]})
_bronze("bronze_error_codes", {"not_null": ["error_code", "_loaded_at"], "accepted_values": [("severity", SEVERITIES)]})
_bronze("bronze_device_events", {
    "not_null": ["event_id", "event_type_code", "event_timestamp", "load_date", "_loaded_at"],
    "relationships": [("machine_id", "bronze_machines", "machine_id"), ("event_type_code", "bronze_event_types", "event_type_code")],
})


@telemetry.model("silver", ["bronze_machines", "bronze_device_events"], checks={
    **_SCD2_CHECKS, "not_null": ["machine_sk", "machine_id", "valid_from", "is_current"],
    "relationships": [("machine_id", "bronze_machines", "machine_id")],
    "accepted_values": [("machine_type", MACHINE_TYPES), ("status_value", STATUSES)],
    "unique_combination": [["machine_id", "valid_from"]], "singular": [quality.scd2_overlap, quality.one_current],
})
def silver_dim_machines(ctx: Context) -> DataFrame:
    return models.dim_machines(ctx.ref("bronze_device_events"), ctx.ref("bronze_machines"))


@telemetry.model("silver", ["bronze_device_events", "bronze_machines", "bronze_event_types", "silver_dim_machines"], checks={
    "unique": ["event_id"], "not_null": ["event_id", "machine_id", "event_type_code", "event_timestamp", "load_date"],
    "relationships": [("machine_id", "silver_dim_machines", "machine_id")], "min_rows": 1,
})
def silver_fact_device_events(ctx: Context) -> DataFrame:
    return models.fact_device_events(ctx.ref("bronze_device_events"), ctx.ref("bronze_machines"), ctx.ref("bronze_event_types"))


@telemetry.model("silver", ["silver_fact_device_events", "bronze_error_codes"], checks={
    "unique": ["error_event_sk"], "not_null": ["error_event_sk", "machine_id", "error_code", "raised_at"],
    "relationships": [("error_code", "bronze_error_codes", "error_code")], "accepted_values": [("severity", SEVERITIES)],
    "between": [("resolution_time_seconds", 0, None)],
})
def silver_fact_error_events(ctx: Context) -> DataFrame:
    return models.fact_error_events(ctx.ref("silver_fact_device_events"), ctx.ref("bronze_error_codes"))


@telemetry.model("silver", ["bronze_machines", "bronze_event_types"], "state", ["tec"], {
    "not_null": ["machine_id", "event_type_code", "last_processed_event_timestamp"],
    "unique_combination": [["model_name", "machine_id", "event_type_code"]],
})
def silver_tec_watermark(ctx: Context) -> DataFrame:
    seeded = None
    state = ctx.state("silver_tec_watermark").read(0 if ctx.full_refresh else None)
    for name in FREQUENCY:
        own = models.seed_watermark(ctx.ref("bronze_machines"), ctx.ref("bronze_event_types"), state.filter(state.model_name == name))
        own = own.selectExpr("*", f"'{name}' model_name")
        seeded = own if seeded is None else seeded.unionByName(own)
    return seeded


@telemetry.model("silver", ["bronze_machines", "bronze_event_types"], "state", ["tec"], {
    "not_null": ["machine_id", "event_type_code", "kpi_code"], "accepted_values": [("kpi_code", ["all"])],
    "unique_combination": [["machine_id", "event_type_code", "kpi_code"]],
})
def silver_tec_kpi_mapping(ctx: Context) -> DataFrame:
    state = ctx.state("silver_tec_kpi_mapping").read(0 if ctx.full_refresh else None)
    return models.seed_kpi_mapping(ctx.ref("bronze_machines"), ctx.ref("bronze_event_types"), state)


@telemetry.model("silver", [], "state", ["tec"], {
    "not_null": ["batch_run_id", "model_name", "run_started_at", "run_completed_at"],
    "unique_combination": [["batch_run_id", "model_name"]],
})
def silver_tec_batch_execution_log(ctx: Context) -> DataFrame:
    return ctx.spark.createDataFrame([], BATCH_LOG)


@telemetry.model("gold", ["silver_dim_machines", "silver_fact_device_events"], checks={
    "unique": ["machine_id"], "not_null": ["machine_id", "status_since"], "accepted_values": [("status_value", STATUSES)],
})
def dim_machine_status(ctx: Context) -> DataFrame:
    return models.machine_status(ctx.ref("silver_dim_machines"), ctx.ref("silver_fact_device_events"))


@telemetry.model("gold", ["silver_dim_machines"], checks=_SCD2_CHECKS)
def dim_machine_status_history(ctx: Context) -> DataFrame:
    return models.status_history(ctx.ref("silver_dim_machines"))


@telemetry.model("gold", ["silver_dim_machines"], checks={
    "not_null": ["machine_id", "event_date"], "unique_combination": [["machine_id", "event_date"]],
    "between": [("pct_running", 0, 100), ("pct_down", 0, 100), ("pct_idle", 0, 100)],
})
def agg_machine_uptime_daily(ctx: Context) -> DataFrame:
    return models.uptime_daily(ctx.ref("silver_dim_machines"), ctx.vars.get("as_of", ctx.started))


@telemetry.model("gold", ["silver_fact_device_events"], checks={
    "not_null": ["machine_type", "event_date"], "unique_combination": [["machine_type", "event_date"]],
})
def agg_machine_type_performance(ctx: Context) -> DataFrame:
    return models.type_performance(ctx.ref("silver_fact_device_events"))


@telemetry.model("gold", ["silver_fact_error_events", "silver_dim_machines"], checks={
    "not_null": ["machine_type", "error_count"], "accepted_values": [("severity", SEVERITIES)],
})
def agg_error_analysis(ctx: Context) -> DataFrame:
    return models.error_analysis(ctx.ref("silver_fact_error_events"), ctx.ref("silver_dim_machines"))


@telemetry.model("gold", ["silver_fact_device_events"], checks={
    "not_null": ["machine_id", "event_date"], "unique_combination": [["machine_id", "event_date"]],
})
def agg_production_output(ctx: Context) -> DataFrame:
    return models.production_output(ctx.ref("silver_fact_device_events"))


def _frequency(name: str, grain: str) -> None:
    def build(ctx: Context) -> DataFrame:
        marks = ctx.ref("silver_tec_watermark")
        marks = marks.filter(marks.model_name == name).drop("model_name")
        return frequency.event_frequency(ctx.ref("silver_fact_device_events"), grain, marks)

    build.__name__ = name
    deps = ["silver_tec_watermark", "silver_fact_device_events", "silver_tec_batch_execution_log"]
    telemetry.model("gold", deps, tags=["frequency"], checks={
        "not_null": ["machine_id", "event_type_code", "bucket_start", "event_count"], "between": [("event_count", 1, None)],
        "unique_combination": [["machine_id", "event_type_code", "bucket_start"]],
    })(build)


for _name, _grain in FREQUENCY.items():
    _frequency(_name, _grain)
