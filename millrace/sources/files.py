"""Seeds, landing tables and other file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.schemas import RAW, same_layout


class SchemaDrift(ValueError):
    """A batch does not have the layout of the table it is appended to."""


def seed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A raw table from CSV files with a header, in its declared types; a value that does not fit raises."""
    return spark.read.schema(RAW[name]).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def values(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Literal rows, as of an INSERT ... VALUES."""
    return spark.createDataFrame(rows, schema)


def append(df: DataFrame, path: str, declared: T.StructType | None = None, partition: str | None = None) -> None:
    """Appends to a Parquet table; a layout other than ``declared`` raises before anything is written."""
    if declared is not None and not same_layout(df.schema, declared):
        raise SchemaDrift(f"{df.schema.simpleString()} is not {declared.simpleString()}")
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replaces a Parquet table; ``df`` may read from it.

    The new table is written beside the old one, which is moved aside only then. If the second move fails the
    old one is moved back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    place, fs = _folder(spark, path)
    beside, aside = (spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{kind}-{mark}") for kind in ("new", "old"))
    writer = df.write
    try:
        (writer.partitionBy(partition) if partition else writer).parquet(beside.toString())
    except Exception:
        fs.delete(beside, True)
        raise
    held = fs.exists(place)
    if held and not fs.rename(place, aside):
        raise OSError(f"{path} can not be moved aside")
    if not fs.rename(beside, place):
        if held:
            fs.rename(aside, place)
        raise OSError(f"{path} can not be replaced")
    if held:
        fs.delete(aside, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _folder(spark, path)
    return fs.exists(place)


def tables(spark: SparkSession, root: str, namespaces: tuple[str, ...]) -> DataFrame:
    """Namespace and name of each table in the folders ``namespaces`` of ``root``; those beside them have none."""
    rows = []
    for namespace in (None, *namespaces):
        place, fs = _folder(spark, f"{root}/{namespace}" if namespace else root)
        for x in fs.listStatus(place) if fs.exists(place) else ():
            name = x.getPath().getName()
            if x.isDirectory() and name[0] not in "._" and (namespace or name not in namespaces):
                rows.append((namespace, name))
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[0] or "", r[1])), "table_schema string, table_name string")


def describe(df: DataFrame) -> DataFrame:
    """Name, type, place and comment of each column, as of the information schema."""
    rows = [
        (f.name, f.dataType.simpleString(), i, f.metadata.get("comment"))
        for i, f in enumerate(df.schema, 1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, ordinal_position bigint, comment string"
    )


def as_text(df: DataFrame, limit: int = 20) -> str:
    """The first rows as an aligned text table."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in df.limit(limit).collect()]
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])
