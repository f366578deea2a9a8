"""Schemas, domains and comments of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(),
}


def _schema(text: str) -> T.StructType:
    """A schema from ``name type`` pairs; a ``!`` after the type forbids nulls by contract (see quality)."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        meta = {"comment": COMMENTS[name]} if name in COMMENTS else {}
        fields.append(T.StructField(name, _KINDS[kind.rstrip("!")], True, meta))
    return T.StructType(fields)


COMMENTS = {
    "event_id": "Identifier that the device gave the event; the same for every delivery of it",
    "machine_id": "Machine that sent the event, or that the row is about",
    "machine_type": "Kind of machine",
    "event_type_code": "Kind of event",
    "event_timestamp": "Instant of the event on the device, UTC",
    "event_date": "Day of the event",
    "status_value": "Status that the machine went to",
    "temperature_c": "Temperature in degrees Celsius, of temperature readings",
    "speed_units_per_min": "Speed in units a minute, of speed readings",
    "vibration_mm_s": "Vibration in millimetres a second, of vibration readings",
    "product_count": "Products made, of counts and completed cycles",
    "cycle_duration_seconds": "Length of a completed cycle in seconds",
    "error_code": "Code of the fault that was raised or resolved",
    "source_ingested_at": "Instant at which the source received the event; later for a repeated delivery",
    "load_date": "Batch that brought the row; not always the day of the event",
    "_loaded_at": "Instant at which the row was landed",
    "model_name": "Model of the machine; in the state tables, the model that the row belongs to",
    "manufacturer": "Maker of the machine",
    "plant_location": "Plant in which the machine stands",
    "plant_country": "Country of the plant",
    "install_date": "Day on which the machine was installed",
    "rated_capacity": "Capacity that the maker names",
    "capacity_unit": "Unit of the rated capacity",
    "initial_firmware_version": "Firmware that the machine was delivered with",
    "event_category": "Group of kinds of events",
    "description": "What the code means",
    "has_numeric_payload": "Whether events of this kind carry a number",
    "severity": "How grave the fault is",
    "requires_maintenance": "Whether the fault calls for maintenance",
    "valid_from": "Begin of the version, included",
    "valid_to": "End of the version, excluded; null while it is in force",
    "event_value": "The reading that the event's type stands for",
    "last_processed_event_timestamp": "High-water mark: later events are new",
    "kpi_code": "Figure that the combination counts towards",
    "batch_run_id": "Run that wrote the row",
    "row_count": "Rows of the run's output",
    "distinct_machine_count": "Machines in the run's output",
    "distinct_event_count": "Kinds of events in the run's output",
    "duration_seconds": "Whole seconds that the run took",
    "run_started_at": "Begin of the run",
    "run_completed_at": "End of the run",
}

_EVENT = (
    "event_id string, machine_id string, machine_type string, event_type_code string, event_timestamp timestamp, "
    "event_date date, status_value string, temperature_c double, speed_units_per_min double, vibration_mm_s double, "
    "product_count bigint, cycle_duration_seconds bigint, error_code string, source_ingested_at timestamp, load_date date"
)
_MACHINE = (
    "machine_id string, machine_type string, model_name string, manufacturer string, plant_location string, "
    "plant_country string, install_date date, rated_capacity double, capacity_unit string, initial_firmware_version string"
)
_TYPE = "event_type_code string, event_category string, description string, has_numeric_payload boolean"
_ERROR = "error_code string, severity string, description string, requires_maintenance boolean"

RAW = {
    "raw_device_events": _schema(_EVENT), "raw_machines": _schema(_MACHINE),
    "raw_event_types": _schema(_TYPE), "raw_error_codes": _schema(_ERROR),
}
BRONZE = {
    name.replace("raw_", "bronze_"): T.StructType([*schema.fields, *_schema("_loaded_at timestamp").fields])
    for name, schema in RAW.items()
}
WATERMARK = _schema("machine_id string, event_type_code string, last_processed_event_timestamp timestamp")
KPI_MAPPING = _schema("machine_id string, event_type_code string, kpi_code string")
BATCH_LOG = _schema(
    "batch_run_id string, model_name string, row_count bigint, distinct_machine_count bigint, distinct_event_count bigint, "
    "duration_seconds bigint, run_started_at timestamp, run_completed_at timestamp"
)

# Domains of the telemetry tables.
MACHINE_TYPES = ["SLICER", "COOKER", "BAKER", "PACKER"]
STATUSES = ["RUNNING", "IDLE", "STOPPED", "MAINTENANCE", "ERROR"]
DOWN = ["STOPPED", "MAINTENANCE", "ERROR"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
CATEGORIES = ["lifecycle", "production", "telemetry", "fault", "maintenance"]
#: Event type to the column that holds its reading.
READINGS = {
    "SENSOR_TEMPERATURE_READING": "temperature_c", "SENSOR_SPEED_READING": "speed_units_per_min",
    "SENSOR_VIBRATION_READING": "vibration_mm_s", "PRODUCT_COUNT_UPDATE": "product_count",
    "CYCLE_COMPLETE": "product_count",
}
#: Sensor event type to the short name of the sensor and the column of its reading.
SENSORS = {
    "SENSOR_TEMPERATURE_READING": ("temperature", "temperature_c"),
    "SENSOR_SPEED_READING": ("speed", "speed_units_per_min"),
    "SENSOR_VIBRATION_READING": ("vibration", "vibration_mm_s"),
}


def same_layout(found: T.StructType, declared: T.StructType) -> bool:
    """Whether names and types agree, in any order."""
    return {(f.name, f.dataType) for f in found} == {(f.name, f.dataType) for f in declared}
