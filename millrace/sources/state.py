"""Keyed state tables on plain Parquet: versioned snapshots with upserts and optimistic concurrency.

A commit writes the partitions that it changes as new folders, and then claims the next version by a
marker that lists the folders of all partitions. The marker is written beside its place and moved there as a
whole, which fails if another writer was first: a reader finds a whole marker or none. A lost writer or
executor leaves at most unmarked folders behind; ``vacuum`` removes them and old versions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StaleVersion(RuntimeError):
    """Another writer has committed since the base version was read."""


def upsert(state: DataFrame, source: DataFrame, keys: list[str], insert: bool = True) -> DataFrame:
    """``state`` with rows of ``source`` in place of those with the same keys, and new ones if ``insert``.

    Null keys match nothing: such rows of the state stay, such rows of the source are inserted.
    """
    kept = state.join(source.select(*keys), keys, "left_anti").select(*state.columns)
    new = source.select(*state.columns)
    if not insert:
        new = new.join(state.select(*keys), keys, "left_semi").select(*state.columns)
    return kept.unionByName(new)


def update(state: DataFrame, where, **assign) -> DataFrame:
    """``state`` with the columns of ``assign`` set in rows where ``where`` holds."""
    return state.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in assign.items()})


def delete(state: DataFrame, where) -> DataFrame:
    """``state`` without the rows where ``where`` holds; a null verdict keeps the row."""
    return state.filter(~F.coalesce(where, F.lit(False)))


class StateTable:
    """A state table in a folder of any Hadoop file system.

    With ``keys`` its rows are spread over ``buckets`` by a hash of them, and a change can be confined to
    the buckets that hold the keys it is about. Without, there is one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.buckets = keys, buckets if keys else 1
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration()
        )
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._no_overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        marks = self._path(f"{self.path}/_versions")
        if not self._fs.exists(marks):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(marks))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self._versions(), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/_versions/{version}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        # A marker of an earlier layout is the name of its only folder.
        return {int(b): f for b, f in json.loads(text).items()} if text.startswith("{") else {0: text}

    def bucket(self, df: DataFrame) -> DataFrame:
        """``df`` with the bucket of each row, as ``_bucket``."""
        hashed = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)) if self.keys else F.lit(0)
        return df.withColumn("_bucket", hashed.cast("int"))

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table at a version, the newest by default; of some buckets, if given."""
        version = self.version() if version is None else version
        folders = {f for b, f in self._folders(version).items() if only is None or b in only}
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def commit(self, df: DataFrame, base: int, only: set[int] | None = None) -> int:
        """Makes ``df`` the version after ``base``; raises StaleVersion if that exists already.

        With ``only``, ``df`` replaces those buckets and the others stay as they are in ``base``.
        """
        folder = f"data-{uuid.uuid4().hex}"
        rows = self.bucket(df.select(*self.schema.fieldNames()))
        if self.keys:
            rows = rows.repartition("_bucket")
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))
        new = {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}
        kept = {} if only is None else {b: f for b, f in self._folders(base).items() if b not in only}
        draft, marker = self._path(f"{self.path}/_versions/_{folder}"), self._path(f"{self.path}/_versions/{base + 1}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(kept | new).encode()))
        stream.close()
        try:
            self._context.rename(draft, marker, self._no_overwrite)
        except Exception as error:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            if not self._fs.exists(marker):
                raise
            raise StaleVersion(f"version {base + 1} of {self.path} exists") from error
        return base + 1

    def change(self, make: Callable[[DataFrame], DataFrame]) -> int:
        """Commits ``make`` of the newest version."""
        base = self.version()
        return self.commit(make(self.read(base)), base)

    def change_keys(self, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Commits ``make`` of the buckets that hold the keys of ``source``; the others are not read or written."""
        base = self.version()
        # At most ``buckets`` numbers.
        touched = {r[0] for r in self.bucket(source.select(*self.keys)).select("_bucket").distinct().collect()}
        return self.commit(make(self.read(base, touched)), base, touched) if touched else base

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400.0) -> list[str]:
        """Removes all but the newest ``keep`` versions, at least one, and folders that no version lists; returns the folders' names.

        A folder younger than ``older_than_s`` stays, as its writer may be about to list it.
        """
        known, keep = self._versions(), max(1, keep)
        for version in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_versions/{version}"), False)
        used = {f.split("/")[0] for v in known[-keep:] for f in self._folders(v).values()}
        gone, now = [], time.time() * 1000
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in used and s.getModificationTime() <= now - older_than_s * 1000:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
