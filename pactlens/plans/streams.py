"""Queries over streams that come in several batches and out of order, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.lineage import scratch
from pactlens.plans.catalogue import AS_OF, _campaigns
from pactlens.plans.registry import ORACLES, query, table
from pactlens.streaming.late import CorrectedUsage
from pactlens.streaming.machine import evaluate_stream
from pactlens.streaming.sliding import sliding_usage
from pactlens.streaming.usage import with_rocksdb

CALLS = "endpoint_id string, client_id string, ts timestamp"
#: A last row that moves the watermark past all others, as later traffic would.
AFTER = "2030-01-01 00:00:00"


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("endpoint_id"), F.col("user_id").cast("string").alias("client_id"), F.col("ts").cast("timestamp").alias("ts"))


def in_batches(spark: SparkSession, parts: list[DataFrame], shape: str) -> DataFrame:
    """A stream that reads each part in a batch of its own, in order.

    A batch is one file, which one task reads; its rows are dealt out before anything is kept in memory.
    """
    path = scratch(spark, "parts")
    for part in parts:
        part.repartition(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *stream.columns)


def to_end(stream: DataFrame) -> DataFrame:
    """The rows that a stream has appended once it has read all there is."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "appended")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "appending"))
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(ORACLES["rolling_usage"])
def stream_rolling(spark, sf_dir):
    """Look-backs of campaigns of different lengths over a stream in three batches, the second of which comes late but in time."""
    calls = calls_of(spark, sf_dir)
    last = spark.createDataFrame([("", "", AFTER)], "endpoint_id string, client_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    even = F.col("event_id") % 2 == 0
    stream = in_batches(spark, [calls.filter(even).drop("event_id"), calls.filter(~even).drop("event_id"), last], CALLS)
    campaigns = _campaigns(spark, sf_dir)
    found = to_end(sliding_usage(stream, campaigns, late="40 days")).filter(F.col("as_of") == F.lit(AS_OF).cast("timestamp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return campaigns.select("id").join(found, "id", "left").select("id", zero("usage_count"), zero("client_count"))


@query(ORACLES["fsm_replay"])
def stream_machine(spark, sf_dir):
    """The state machine of every client over daily counts in three batches, later days first."""
    daily = calls_of(spark, sf_dir).groupBy(F.col("client_id").alias("id"), F.date_trunc("day", "ts").alias("sampled_at")).agg(F.count("*").alias("usage_count"))
    shape = "id string, sampled_at timestamp, usage_count bigint"
    last = spark.createDataFrame([("", AFTER, 0)], "id string, sampled_at string, usage_count bigint").withColumn("sampled_at", F.col("sampled_at").cast("timestamp"))
    odd = F.dayofmonth("sampled_at") % 2 == 1
    start = daily.groupBy("id").agg(F.max("usage_count").alias("peak_usage")).withColumns({"state": F.lit("active"), "usage_threshold_pct": F.lit(60.0), "decay_window_days": F.lit(30)})
    session = with_rocksdb(spark)
    path = scratch(spark, "machine")
    for name, df in (("start", start), ("odd", daily.filter(odd)), ("even", daily.filter(~odd)), ("last", last)):
        df.write.parquet(f"{path}-{name}")
    parts = [session.read.parquet(f"{path}-{name}") for name in ("odd", "even", "last")]
    states = to_end(evaluate_stream(in_batches(session, parts, shape), session.read.parquet(f"{path}-start"), late="40 days"))
    return states.groupBy(F.col("id").cast("bigint").alias("user_id")).agg(F.max_by("state", "sampled_at").alias("state"))


@query(ORACLES["usage_windows"])
def stream_corrections(spark, sf_dir):
    """Usage windows with a watermark of an hour over four batches, three of which come almost wholly too late, and the corrections."""
    calls = calls_of(spark, sf_dir)
    parts = [calls.filter(F.col("event_id") % 4 == n).drop("event_id") for n in range(4)]
    usage = CorrectedUsage(spark, scratch(spark, "corrected"))
    last = usage.run(in_batches(spark, parts, CALLS), scratch(spark, "correcting"), delay="1 hour")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return usage.corrected(last).select("endpoint_id", "client_id", show("window_start"), show("window_end"), "request_count")
