"""Keyed tables in the shared folder: writes touch the buckets of their keys only, and become visible at once.

A table is split into buckets by a hash of its key.  A version is one small file that says which folder
holds each bucket; a write puts the buckets that it touches into a folder of their own and then names
them, with all others, in the next version.  Data files never change, so readers keep what they began
with, and a write that fails before its version is named has no effect.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.operators.store import insert_absent, merge_by_key

#: The column that names a bucket on disk; no column of a table may have that name.
BUCKET = "key_bucket"


class WriteConflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class KeyedTable:
    """A table of `shape` at `path` with one row per key; null keys compare equal.

    `buckets` is fixed when the first version is written: choose it so that one bucket, which is the
    least that a write rewrites, suits a few tasks.
    """

    def __init__(self, spark: SparkSession, path: str, shape: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = T.StructType.fromDDL(shape)
        if BUCKET in self.schema.names or not set(keys) <= set(self.schema.names) or buckets < 1:
            raise ValueError("keys must be columns, and key_bucket must be none")

    # Versions ---------------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        fs, folder = self._hadoop(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _state(self, version: int | None = None) -> dict:
        """version, buckets on disk (bucket to folder), how many there are, and the last batch of each writer."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "count": self.buckets, "held": {}, "applied": {}}
        text = self.spark.read.text(f"{self.path}/versions/v{known[-1] if version is None else version}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        fs, folder = self._hadoop(f"{self.path}/versions")
        fs.mkdirs(folder)
        _, draft = self._hadoop(f"{self.path}/versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._hadoop(f"{self.path}/versions/v{state['version']}")[1], none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise WriteConflict(f"version {state['version']} of {self.path} exists") from None
            raise

    # Reads ------------------------------------------------------------------------------------------

    def _rows(self, spark: SparkSession, state: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(state["held"].items()) if only is None or int(b) in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """The rows of a version that is still kept, by default of the latest one."""
        return self._rows(spark or self.spark, self._state(version))

    # Writes -----------------------------------------------------------------------------------------

    def _write(self, incoming: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None) -> int:
        spark, state = incoming.sparkSession, self._state()
        if batch and state["applied"].get(batch[0], -1) >= batch[1]:
            return 0
        bucket = lambda df: df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(state["count"])).cast("int"))
        incoming = incoming.select(*[F.col(c).cast(self.schema[c].dataType) for c in self.schema.names if c in incoming.columns])
        touched = {r[0] for r in bucket(incoming).select(BUCKET).distinct().collect()}
        if touched:
            folder = uuid.uuid4().hex
            after = change(self._rows(spark, state, touched), incoming).select(*self.schema.names)
            # A rebalancing exchange keeps a bucket together, but can split one that is large.
            bucket(after).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            fs, root = self._hadoop(f"{self.path}/data/{folder}")
            written = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.isDirectory() and "=" in s.getPath().getName()}
            held = {b: f for b, f in state["held"].items() if int(b) not in touched} | {str(b): folder for b in written}
        else:
            held = state["held"]
        applied = state["applied"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"version": state["version"] + 1, "count": state["count"], "held": held, "applied": applied})
        return len(touched)

    def upsert(self, incoming: DataFrame, resolve: dict[str, Callable[[Column, Column], Column]] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Merge rows by key as merge_by_key() does; returns how many buckets were rewritten.

        incoming has one row per key and may lack columns.  `batch` is a writer and the number of its
        batch: a number that this writer has committed already changes nothing, so a batch that is
        tried again counts once.  A WriteConflict leaves the table as it is; write again.
        """
        return self._write(incoming, lambda old, new: merge_by_key(old, new, self.keys, resolve or {}), batch)

    def insert(self, incoming: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add the rows whose key is new, one per key."""
        blank = [c for c in self.schema.names if c not in incoming.columns]
        full = incoming.withColumns({c: F.lit(None).cast(self.schema[c].dataType) for c in blank}) if blank else incoming
        return self._write(full, lambda old, new: old.unionByName(insert_absent(old, new, self.keys).select(*old.columns)), batch)

    def delete(self, gone: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Remove the rows of these keys."""
        return self._write(gone.select(*self.keys), lambda old, new: _without(old, new, self.keys), batch)

    def clean(self, keep: int = 2) -> None:
        """Remove all but the last `keep` versions and the data that none of those names: not while others write."""
        known = self.versions()
        states = [self._state(v) for v in known[-max(1, keep) :]]
        named = {folder for s in states for folder in s["held"].values()}
        for v in known[: -max(1, keep)]:
            fs, target = self._hadoop(f"{self.path}/versions/v{v}")
            fs.delete(target, False)
        fs, data = self._hadoop(f"{self.path}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)


def _without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    a, b = old.alias("o"), gone.distinct().alias("n")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return a.join(b, same, "left_anti")
