"""A small telemetry generator. Every value is a hash of its row's number, so a seed gives the same rows
on any number of partitions."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import MACHINE_TYPES, RAW, READINGS, SEVERITIES, STATUSES

# Weights of dense event types, minutes to resolution by severity.
DENSE = {
    "SENSOR_TEMPERATURE_READING": 0.26, "SENSOR_SPEED_READING": 0.24, "SENSOR_VIBRATION_READING": 0.2,
    "PRODUCT_COUNT_UPDATE": 0.14, "CYCLE_START": 0.08, "CYCLE_COMPLETE": 0.08,
}
DELAY = {"LOW": (5, 30), "MEDIUM": (15, 90), "HIGH": (60, 360), "CRITICAL": (240, 1440)}
WEEKEND, NIGHT = 0.4, 0.15


def uniform(seed: int, salt: str, *ids: Column) -> Column:
    """A number in [0, 1) that depends on ``ids`` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *ids), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, salt: str, *ids: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    u, v = uniform(seed, salt + "/u", *ids), uniform(seed, salt + "/v", *ids)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * v)


def choice(u: Column, weights: dict[str, float]) -> Column:
    """The key in whose share of the weights ``u`` falls."""
    total, upto, picked = sum(weights.values()), 0.0, None
    for key, weight in weights.items():
        upto += weight / total
        picked = F.when(u < upto, key) if picked is None else picked.when(u < upto, key)
    return picked.otherwise(list(weights)[-1])


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def machines(spark: SparkSession, n: int) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, MACHINE_TYPES)), (F.col("id") % 4 + 1).cast("int"))
    made = spark.range(n).select(
        F.concat(F.substring(kind, 1, 2), F.lit("-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("machine_id"),
        kind.alias("machine_type"), F.lit("model").alias("model_name"), F.lit("maker").alias("manufacturer"),
        F.concat(F.lit("Plant "), F.col("id") % 5).alias("plant_location"), F.lit("X").alias("plant_country"),
        F.lit(dt.date(2015, 1, 1)).alias("install_date"), (500 + F.col("id") % 900).cast("double").alias("rated_capacity"),
        F.lit("units/hour").alias("capacity_unit"), F.concat(F.lit("v1."), F.col("id") % 9).alias("initial_firmware_version"),
    )
    return made.select(*RAW["raw_machines"].fieldNames())


def _row(df: DataFrame, **given: Column) -> DataFrame:
    """``df`` in the raw layout; what is not given is null."""
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW["raw_device_events"]], "_no", "_kind")


def device_events(
    spark: SparkSession, fleet: DataFrame, error_codes: DataFrame, first_day: dt.date, days: int, per_machine: int, seed: int = 42
) -> DataFrame:
    """Raw device events of ``fleet``: readings, status cycles, faults and alerts, with late and repeated
    deliveries (2 %), and lost machine ids (0.5 % of all rows, repeated ones among them)."""
    start = F.unix_timestamp(F.lit(first_day).cast("timestamp"))
    end = start + days * 86_400
    at = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    m = fleet.select("machine_id", "machine_type")

    def each(n: int, kind: str) -> DataFrame:
        return m.withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_kind", F.lit(kind))

    ids = (F.col("machine_id"), F.col("_kind"), F.col("_no"))
    u = lambda salt: uniform(seed, salt, *ids)
    # Days by weight of weekday, hours by weight of day and night.
    day_weights = {str(i): WEEKEND if (first_day + dt.timedelta(i)).weekday() >= 5 else 1.0 for i in range(days)}
    hour_weights = {str(h): 1.0 if 6 <= h < 22 else NIGHT for h in range(24)}
    second = (
        start + choice(u("day"), day_weights).cast("int") * 86_400 + choice(u("hour"), hour_weights).cast("int") * 3600
        + F.floor(u("second") * 3600)
    )
    code = choice(u("code"), DENSE)
    drift = F.sin((second - start) / 86_400.0 * 2 * math.pi)
    noise = normal(seed, "value", *ids)
    reading = {
        "temperature_c": F.round(_clip(180 + 15 * drift + 6 * noise, 60, 260), 2),
        "speed_units_per_min": F.round(_clip(80 + 8 * drift + 5 * noise, 0, 160), 2),
        "vibration_mm_s": F.round(_clip(2 + 0.5 * drift + 0.6 * noise, 0.1, 12), 3),
        "product_count": F.floor(50 + u("products") * 450),
    }
    payload = {
        c: F.when(code.isin(*[k for k, x in READINGS.items() if x == c]), v) for c, v in reading.items()
    }
    dense = _row(
        each(per_machine, "dense"), machine_id=F.col("machine_id"), machine_type=F.col("machine_type"), event_type_code=code,
        event_timestamp=at(second), cycle_duration_seconds=F.when(code == "CYCLE_COMPLETE", F.floor(30 + u("cycle") * 5370)), **payload,
    )
    # Statuses go round in a fixed order from a start of each machine's own.
    turn = (F.pmod(F.xxhash64("machine_id"), F.lit(len(STATUSES))) + F.col("_no")) % len(STATUSES) + 1
    changed = start + F.floor((F.col("_no") + u("status")) * (days * 86_400 / 7.0))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), turn.cast("int"))
    statuses = _row(
        each(7, "status"), machine_id=F.col("machine_id"), machine_type=F.col("machine_type"),
        event_type_code=F.lit("STATUS_CHANGE"), event_timestamp=at(changed), status_value=status,
    )
    ahead = F.floor((1 + u("ahead") * 47) * 3600)
    alerts = _row(
        each(7, "alert").filter((status == "MAINTENANCE") & (u("alert") < 0.7)), machine_id=F.col("machine_id"),
        machine_type=F.col("machine_type"), event_type_code=F.lit("MAINTENANCE_ALERT"), event_timestamp=at(F.greatest(start, changed - ahead)),
    )
    # Faults: a code by hash, its resolution after a delay by severity, not beyond the end.
    codes = error_codes.select("error_code", "severity").distinct()
    numbered = codes.agg(F.sort_array(F.collect_list(F.struct("error_code", "severity"))).alias("_codes"))  # a fixed list
    fault = each(3, "fault").crossJoin(F.broadcast(numbered))
    picked = F.element_at("_codes", (F.pmod(F.xxhash64(F.lit(seed), *ids), F.size("_codes")) + 1).cast("int"))
    delay = F.lit(0.0)
    for severity in SEVERITIES:
        low, high = DELAY[severity]
        delay = F.when(picked["severity"] == severity, low + u("delay") * (high - low)).otherwise(delay)
    raised = start + F.floor(u("raised") * (days * 86_400 - 60))
    resolved = F.least(raised + F.floor(delay * 60), end - 1)
    fault = fault.withColumn("_end", F.explode(F.array(F.lit(False), F.lit(True))))
    faults = _row(
        fault, machine_id=F.col("machine_id"), machine_type=F.col("machine_type"), error_code=picked["error_code"],
        event_type_code=F.when(F.col("_end"), "ERROR_RESOLVED").otherwise("ERROR_RAISED"),
        event_timestamp=at(F.when(F.col("_end"), resolved).otherwise(raised)),
    )
    rows = dense.unionByName(statuses).unionByName(alerts).unionByName(faults)
    own = (F.col("machine_id"), F.col("_kind"), F.col("_no"), F.col("event_type_code"))
    seconds = F.unix_timestamp(F.col("event_timestamp").cast("timestamp"))
    straggles = uniform(seed, "straggler", *own) < 0.03
    lag = F.when(straggles, 300 + F.floor(uniform(seed, "long", *own) * 3300)).otherwise(F.floor(uniform(seed, "lag", *own) * 121))
    last = F.lit(first_day + dt.timedelta(days - 1))
    key = F.md5(F.concat_ws("/", F.lit(seed), *own))
    rows = rows.withColumns({
        "event_id": F.regexp_replace(key, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-8$4-$5"),
        "event_date": F.to_date("event_timestamp"), "source_ingested_at": at(seconds + lag),
    })
    rows = rows.withColumn("load_date", F.least(F.to_date("source_ingested_at"), last)).withColumn("_copy", F.lit(0))
    again = rows.filter(uniform(seed, "again", *own) < 0.02).withColumns({
        "source_ingested_at": at(F.unix_timestamp(F.col("source_ingested_at").cast("timestamp")) + 1800 + F.floor(uniform(seed, "later", *own) * 5400)),
        "load_date": F.least(F.date_add("load_date", 1), last), "_copy": F.lit(1),
    })
    lost = uniform(seed, "lost", *own, F.col("_copy")) < 0.005
    both = rows.unionByName(again).withColumn("_lost", lost)
    both = both.withColumn("machine_id", F.when(~F.col("_lost"), F.col("machine_id")))
    return both.select(*RAW["raw_device_events"].fieldNames())
