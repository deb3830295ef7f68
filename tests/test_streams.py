"""Streams in several batches: out of order, too late, tried again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pactlens.functions.lineage import scratch
from pactlens.operators import campaigns as campaign_ops
from pactlens.plans import streams
from pactlens.streaming import machine, sliding
from pactlens.streaming.late import CorrectedUsage, merged, windows_of
from pactlens.streaming.usage import with_rocksdb

DAY = datetime(2024, 1, 1)
END = (None, None, "2030-01-01 00:00:00")


def calls(spark, rows):
    return spark.createDataFrame([(e, c, str(t) if t else None) for e, c, t in rows], "endpoint_id string, client_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_look_backs_slide_as_the_batch_counts_them(spark):
    rows = [("e", f"c{n % 3}", DAY + timedelta(hours=7 * n)) for n in range(30)] + [("f", "c9", DAY + timedelta(days=2))]
    plans = spark.createDataFrame([("long", "e", 5), ("short", "e", 1), ("other", "f", 3), ("idle", "g", 3)], "id string, endpoint_id string, decay_window_days int")
    parts = [calls(spark, rows[20:30]), calls(spark, rows[:10]), calls(spark, rows[10:20] + rows[30:]), calls(spark, [("", "", "2030-01-01 00:00:00")])]
    found = streams.to_end(sliding.sliding_usage(streams.in_batches(spark, parts, streams.CALLS), plans, late="40 days"))
    got = {(r.id, str(r.as_of)[:10]): (r.usage_count, r.client_count) for r in found.collect()}
    windows = campaign_ops.usage_windows(calls(spark, rows))
    for days in range(1, 15):
        as_of = DAY + timedelta(days=days)
        before = windows.filter(F.col("window_end") <= F.lit(str(as_of)).cast("timestamp"))
        for r in campaign_ops.rolling_usage(plans, before, F.lit(str(as_of)).cast("timestamp")).collect():
            assert got.get((r.id, str(as_of)[:10]), (0, 0)) == (r.usage_count, r.client_count), (r, as_of)


def test_look_back_of_years(spark):
    plans = spark.createDataFrame([("c", "e", "active", 800)], "id string, endpoint_id string, state string, decay_window_days int")
    windows = campaign_ops.usage_windows(calls(spark, [("e", "c", DAY - timedelta(days=700)), ("e", "c", DAY - timedelta(days=900))]))
    assert campaign_ops.rolling_usage(plans, windows, F.lit(str(DAY)).cast("timestamp")).first().usage_count == 1


def evaluated(spark, batches, start, late="10 days"):
    session = with_rocksdb(spark)
    frames = [session.createDataFrame([(i, str(t), n) for i, t, n in rows], "id string, sampled_at string, usage_count bigint").withColumn("sampled_at", F.col("sampled_at").cast("timestamp")) for rows in [*batches, [("", "2030-01-01 00:00:00", 0)]]]
    stream = streams.in_batches(session, frames, "id string, sampled_at timestamp, usage_count bigint")
    campaigns = session.createDataFrame(start, "id string, state string, peak_usage bigint, usage_threshold_pct double, decay_window_days int")
    found = streams.to_end(machine.evaluate_stream(stream, campaigns, late))
    return {(r.id, str(r.sampled_at)): (r.usage_count, r.ewma_value, r.previous_state, r.state) for r in found.collect()}


def test_machine_takes_samples_in_their_own_order(spark):
    at = lambda seconds: DAY + timedelta(seconds=seconds)
    start = [("a", "active", 100, 50.0, 3), ("b", "draft", 100, 50.0, 3), ("zero", "active", 0, 50.0, 3)]
    # Later times come first; the second transition of `a` falls into the lock and waits for a sample after it.
    batches = [
        [("a", at(100), 0), ("a", at(3), 0), ("b", at(1), 0), ("nobody", at(1), 1)],
        [("a", at(0), 80), ("a", at(1), 20), ("a", at(1), 40), ("zero", at(0), 7)],
    ]
    got = evaluated(spark, batches, start)
    assert got == {
        ("a", str(at(0))): (80, 80.0, "active", "active"),
        ("a", str(at(1))): (40, 60.0, "active", "decaying"),
        ("a", str(at(3))): (0, 30.0, "decaying", "decaying"),
        ("a", str(at(100))): (0, 15.0, "decaying", "ready_to_remove"),
        ("b", str(at(1))): (0, 0.0, "draft", "draft"),
        ("zero", str(at(0))): (7, 7.0, "active", "decaying"),
    }


def test_samples_behind_the_watermark_count_for_nothing(spark):
    start = [("a", "active", 100, 50.0, 3)]
    batches = [[("a", DAY + timedelta(days=5), 90)], [("a", DAY + timedelta(days=6), 90)], [("a", DAY, 0)]]
    got = evaluated(spark, batches, start, late="1 hour")
    assert len(got) == 2 and {x[3] for x in got.values()} == {"active"}


@pytest.mark.parametrize("delay", ["1 hour", "3 days", "400 days"])
def test_corrections_make_up_for_what_was_late(spark, delay):
    rows = [("e", f"c{n % 2}", DAY + timedelta(hours=5 * ((n * 17) % 60))) for n in range(60)] + [("e", "c0", None)]
    parts = [calls(spark, rows[i::4]) for i in range(4)]
    usage = CorrectedUsage(spark, scratch(spark, "usage"))
    last = usage.run(streams.in_batches(spark, parts, streams.CALLS), scratch(spark, "checkpoint"), delay)
    want = sorted(map(tuple, windows_of(calls(spark, rows).filter("ts IS NOT NULL")).collect()))
    assert last == 3 and sorted(map(tuple, usage.corrected(last).collect())) == want
    late, on_time = usage.corrections(), usage.on_time(last)
    assert (late.count() > 0) == (delay != "400 days") and sum(r.request_count for r in late.collect()) + sum(r.request_count for r in on_time.collect()) == 60
    # A window closes once: the tables of on-time windows never hold it twice.
    assert on_time.count() == merged(on_time).count()


def test_a_batch_that_is_tried_again_counts_once(spark):
    usage = CorrectedUsage(spark, scratch(spark, "usage"))
    batches = [calls(spark, [("e", "c", DAY), ("e", "c", DAY + timedelta(days=3))]), calls(spark, [("e", "c", DAY), ("e", "c", DAY + timedelta(days=3))]), calls(spark, [])]
    for number, batch in enumerate(batches):
        usage.put(batch, number, "1 hour")
        usage.put(batch, number, "1 hour")
    assert {str(r.window_start)[:10]: r.request_count for r in usage.corrected(2).collect()} == {"2024-01-01": 2, "2024-01-04": 2}
    assert sum(r.request_count for r in usage.corrections().collect()) == 1
    import pathlib

    kept = {p.name for p in (pathlib.Path(usage.path.removeprefix("file://")) / "open").iterdir()}
    assert kept == {"version=1", "version=2"}
