"""What streams ask of the state store and of the task that reads a batch."""

import pandas as pd
from pyspark.sql import functions as F

from pactlens.plans import streams
from pactlens.streaming.machine import CampaignMachine
from pactlens.streaming.sliding import sliding_usage


class Store:
    """A handle whose states count the calls made of them."""

    def __init__(self):
        self.calls, self.value, self.rows, self.timers = 0, None, [], set()

    def getValueState(self, name, shape):
        return self

    def getListState(self, name, shape):
        return Listed(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Listed:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return iter(list(self.store.rows))

    def put(self, rows):
        self.store.calls += 1
        self.store.rows = list(rows)

    def appendList(self, rows):
        self.store.calls += 1
        self.store.rows += rows

    def clear(self):
        self.put([])


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_machine_asks_the_store_once_a_batch(spark):
    store, machine = Store(), CampaignMachine()
    machine.init(store)
    batch = lambda days: pd.DataFrame({"sampled_at": pd.to_datetime([f"2024-01-{d:02}" for d in days]), "usage_count": [100 - d for d in days]})
    assert not list(machine.handleInputRows(("x",), iter([batch([3])]), None)) and not store.rows  # an unknown campaign
    machine.handleInitialState(("x",), pd.DataFrame({"state": ["active"], "peak_usage": [100], "usage_threshold_pct": [80.0], "decay_window_days": [30]}), None)
    before = store.calls
    for days in (range(1, 30, 2), range(2, 30, 2), [29, 28]):
        assert not list(machine.handleInputRows(("x",), iter([batch(days)]), None))
    assert store.timers == {int(pd.Timestamp("2024-01-01").timestamp() * 1000) + 1}
    watermark = At(int(pd.Timestamp("2024-01-20 12:00").timestamp() * 1000))
    out = pd.concat(machine.handleExpiredTimer(("x",), watermark, At(min(store.timers))))
    assert list(out["sampled_at"]) == list(pd.date_range("2024-01-01", "2024-01-20")) and list(out["usage_count"]) == [100 - d for d in range(1, 21)]
    assert out["state"].iat[-1] == "active" and len(store.rows) == 11 and int(pd.Timestamp("2024-01-21").timestamp() * 1000) + 1 in store.timers
    rest = pd.concat(machine.handleExpiredTimer(("x",), At(watermark.ms * 2), At(watermark.ms * 2)))
    assert list(rest["usage_count"]) == [100 - d for d in range(21, 30)] and rest["state"].iat[-1] == "decaying" and not store.rows
    assert store.calls - before < 30  # of 29 samples and three batches


def test_batches_are_dealt_out_before_they_are_gathered(spark):
    stream = streams.in_batches(spark, [spark.range(10).selectExpr("id")], "id bigint")
    assert "RepartitionByExpression" in stream._jdf.queryExecution().analyzed().toString()


def test_look_backs_do_not_gather_an_endpoint(spark):
    calls = spark.createDataFrame([("e", "c", "2024-01-01 10:00:00"), ("e", "d", "2024-01-02 10:00:00")], "endpoint_id string, client_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    campaigns = spark.createDataFrame([("x", "e", 1)], "id string, endpoint_id string, decay_window_days int")
    slid = sliding_usage(calls, campaigns)
    assert "strategy=broadcast" in slid._jdf.queryExecution().analyzed().toString()
    assert {(str(r.as_of)[:10], r.usage_count) for r in slid.collect()} == {("2024-01-02", 1), ("2024-01-03", 2), ("2024-01-04", 1)}
