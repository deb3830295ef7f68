"""Rolling usage of campaigns as a stream of sliding event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many campaigns travel to the calls; beyond, both are shuffled by endpoint.
BROADCAST_CAMPAIGNS = 50_000


def sliding_usage(calls: DataFrame, campaigns: DataFrame, late: str = "1 day") -> DataFrame:
    """id, as_of, usage_count, client_count: what each campaign's look-back holds at every midnight, once it is final.

    calls(endpoint_id, client_id, ts) is a stream, campaigns(id, endpoint_id, decay_window_days) a table.
    Calls are counted by day, endpoint and client first; those counts slide, a day at a time, over
    windows as long as the longest look-back, of which each campaign keeps those that its own reaches
    (the whole day that it begins in included), and are summed by client, then by campaign, so that
    clients are counted exactly.  A look-back that holds no call has no row.  Rows later than `late`
    are dropped; see late.py for what can be done with them.
    """
    longest, many = campaigns.agg(F.max("decay_window_days"), F.count("*")).first()
    longest = longest or 0
    daily = (
        calls.withWatermark("ts", late)
        .groupBy("endpoint_id", "client_id", F.window("ts", "1 day").alias("day"))
        .agg(F.count("*").alias("n"))
        .select("endpoint_id", "client_id", "n", F.window_time("day").alias("seen"), F.col("day.end").alias("until"))
    )
    own = campaigns.select("id", "endpoint_id", "decay_window_days")
    # A shuffle by endpoint would gather all calls of one in a task.
    own = F.broadcast(own) if many <= BROADCAST_CAMPAIGNS else own
    slid = daily.join(own, "endpoint_id").withColumn("w", F.window("seen", f"{longest + 1} days", "1 day"))
    reached = slid.filter(F.col("w.end") <= F.col("until") + F.make_dt_interval(F.col("decay_window_days")))
    per_client = reached.groupBy("id", "client_id", "w").agg(F.sum("n").alias("n")).select("id", "n", F.window_time("w").alias("seen"))
    total = per_client.groupBy("id", F.window("seen", "1 day").alias("w")).agg(F.sum("n").alias("usage_count"), F.count("*").alias("client_count"))
    return total.select("id", F.col("w.end").alias("as_of"), "usage_count", "client_count")
