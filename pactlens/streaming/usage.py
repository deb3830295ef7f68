"""Usage windows and smoothing as streams; here driven to the end over files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pactlens.functions.lineage import scratch
from pactlens.operators.ingest import observed_endpoints
from pactlens.operators.tables import KeyedTable

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session beside this one whose streams keep their state in RocksDB, as stateful processors need."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    # A glob, since the table may be one file or a folder of them.
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, width: str = "1 day", late: str = "40 days") -> DataFrame:
    """Requests per endpoint, client and window; events later than `late` are dropped."""
    grouped = events.withWatermark("ts", late).groupBy("event_type", "user_id", F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("request_count")).select(
        F.col("event_type").alias("endpoint_id"), F.col("user_id").cast("string").alias("client_id"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "request_count"
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str, keys: list[str]) -> None:
    """Write a stream's batches by key, idempotently: each batch has a folder of its own, rewritten on retry."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def usage_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all events once the stream has read them; the latest batch holds for each window."""
    out, state = scratch(spark, "usage"), scratch(spark, "usage-state")
    keys = ["endpoint_id", "client_id", "window_start", "window_end"]
    run_to_end(windowed_usage(event_stream(spark, sf_dir)), out, state, "update", keys)
    rows = spark.read.parquet(out)
    return rows.groupBy(*keys).agg(F.max_by("request_count", "batch").alias("request_count"))


ENDPOINTS = "method string, path_template string, sample_count bigint, last_seen_at timestamp, matched boolean"
#: How a batch's endpoints meet the stored ones: counts add up, the latest time and any match hold.
FOLD = {
    "sample_count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "last_seen_at": F.greatest,
    "matched": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
}


def fold_endpoints(calls: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "endpoints") -> None:
    """Fold a stream of calls(method, path_template, ts, matched) to its end into the table of observed endpoints.

    A batch rewrites the buckets of its endpoints only, and one that is tried again counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(observed_endpoints(batch), FOLD, (writer, number))
        table.clean()

    calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def endpoints_by_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000, late: str = "40 days") -> DataFrame:
    """Observed endpoints of a stream that sends every event twice; repeats are dropped by the event's id."""
    table = KeyedTable(spark, scratch(spark, "endpoints"), ENDPOINTS, ["method", "path_template"], buckets=8)
    sent = event_stream(spark, sf_dir, files_per_batch)
    once = sent.unionByName(event_stream(spark, sf_dir, files_per_batch)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    calls = once.select(F.lit("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("path_template"), "ts", (F.col("event_type") != "view").alias("matched"))
    fold_endpoints(calls, table, scratch(spark, "endpoints-state"))
    return table.read()


class Smoother(StatefulProcessor):
    """Keeps the last smoothed value of each key and folds samples in time order."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values("day")
        a = 2.0 / (max(1, self.days) + 1)
        value = self.last.get()[0] if self.last.exists() else None
        out = []
        for day, n in zip(samples["day"], samples["n"]):
            value = round(float(n) if value is None else a * float(n) + (1 - a) * value, 4)
            out.append((key[0], day, value))
        self.last.update((value,))
        yield pd.DataFrame(out, columns=["event_type", "day", "ewma_value"])

    def close(self) -> None:
        pass


def smoothed_stream(daily: DataFrame, days: int = 30) -> DataFrame:
    """event_type, day, ewma_value of a stream of daily counts(event_type, day, n)."""
    return daily.groupBy("event_type").transformWithStateInPandas(
        Smoother(days), outputStructType="event_type string, day timestamp, ewma_value double", outputMode="Append", timeMode="None"
    )


def ewma_by_stream(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """The latest smoothed daily count of each endpoint, from a stream of daily counts."""
    source, out, state = scratch(spark, "daily"), scratch(spark, "ewma"), scratch(spark, "ewma-state")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n")).write.parquet(source)
    daily = with_rocksdb(spark).readStream.schema("event_type string, day timestamp, n bigint").parquet(source)
    run_to_end(smoothed_stream(daily, days), out, state, "append", ["event_type", "day"])
    rows = spark.read.parquet(out)
    return rows.groupBy("event_type").agg(F.max_by("ewma_value", "day").alias("ewma_value"))
