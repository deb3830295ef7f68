"""Usage windows of a stream with a short watermark, and corrections by what came too late."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("endpoint_id", "client_id", "window_start", "window_end")
SHAPE = "endpoint_id string, client_id string, window_start timestamp, window_end timestamp, request_count bigint, last_seen_at timestamp"


def windows_of(calls: DataFrame, width: str = "1 day") -> DataFrame:
    """KEYS, request_count, last_seen_at of calls(endpoint_id, client_id, ts)."""
    grouped = calls.groupBy("endpoint_id", "client_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("request_count"), F.max("ts").alias("last_seen_at"))
    return grouped.select("endpoint_id", "client_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "request_count", "last_seen_at")


def merged(windows: DataFrame) -> DataFrame:
    """One row per window: counts add up and the latest time holds."""
    return windows.groupBy(*KEYS).agg(F.sum("request_count").alias("request_count"), F.max("last_seen_at").alias("last_seen_at"))


@dataclass(frozen=True)
class CorrectedUsage:
    """Tables below one folder, written by the batches of one stream.

    open/version=n holds the windows that batch n left open, and the watermark after it;
    closed/batch=n those that it closed, which no later batch changes; late/batch=n the windows of its
    rows that came when their window was closed already.  A batch that is tried again writes the same
    folders anew, so nothing counts twice; it needs only version n - 1, so older versions are removed.
    Only open windows are rewritten, and how many there are depends on the watermark's delay alone.
    """

    spark: SparkSession
    path: str

    def _read(self, name: str, shape: str = SHAPE, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).parquet(f"{self.path}/{name}").select(*[c.split()[0] for c in shape.split(", ")])

    def _remove(self, name: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def watermark(self, batch: int) -> datetime | None:
        row = self._read(f"watermark/version={batch}", "at timestamp").first()
        return row["at"] if row else None

    def put(self, calls: DataFrame, number: int, delay: str, width: str = "1 day") -> None:
        """Batch `number` of calls(endpoint_id, client_id, ts); rows without a time belong to no window."""
        before = self.watermark(number - 1)
        held = calls.filter("ts IS NOT NULL").persist()
        try:
            latest = held.agg(F.max(F.col("ts") - F.expr(f"INTERVAL {delay}"))).first()[0]
            after = max((x for x in (before, latest) if x is not None), default=None)
            new = windows_of(held, width)
            is_late = F.lit(False) if before is None else F.col("window_end") <= F.lit(before)
            new.filter(is_late).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
            windows = merged(self._read(f"open/version={number - 1}", spark=calls.sparkSession).unionByName(new.filter(~is_late)))
            closes = F.lit(False) if after is None else F.col("window_end") <= F.lit(after)
            windows.filter(closes).write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")
            windows.filter(~closes).write.mode("overwrite").parquet(f"{self.path}/open/version={number}")
            # Last, so that a version with a watermark is whole.
            self.spark.createDataFrame([(after,)] if after else [], "at timestamp").write.mode("overwrite").parquet(f"{self.path}/watermark/version={number}")
        finally:
            held.unpersist()
        for name in ("open", "watermark"):
            self._remove(f"{name}/version={number - 2}")

    def run(self, calls: DataFrame, checkpoint: str, delay: str, width: str = "1 day") -> int:
        """Read a stream of calls to its end; the number of the last batch, -1 without any."""
        query = calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: self.put(batch, n, delay, width)).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress.batchId if query.lastProgress else -1

    def on_time(self, last: int) -> DataFrame:
        """Windows as they were when they closed, and as they stand after batch `last`."""
        return self._read("closed").unionByName(self._read(f"open/version={last}"))

    def corrections(self) -> DataFrame:
        """What came too late, by window: counts to add, and times that may be later."""
        return merged(self._read("late"))

    def corrected(self, last: int) -> DataFrame:
        return merged(self.on_time(last).unionByName(self.corrections()))
