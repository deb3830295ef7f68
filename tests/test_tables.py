"""Keyed tables: what a write touches, what fails, what is tried again, and who else writes."""

import pathlib

import pytest
from pyspark.sql import functions as F

from pactlens.functions.lineage import scratch
from pactlens.operators.tables import KeyedTable, WriteConflict

SHAPE = "k bigint, name string, n bigint"


def table(spark, buckets=16):
    return KeyedTable(spark, scratch(spark, "table"), SHAPE, ["k"], buckets)


def rows(spark, pairs):
    return spark.createDataFrame([(k, f"n{k}", n) for k, n in pairs], SHAPE)


def held(t):
    return sorted(((r.k, r.n) for r in t.read().collect()), key=repr)


def test_a_write_rewrites_the_buckets_of_its_keys_only(spark):
    t = table(spark)
    assert t.insert(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.lit(1).alias("n"))) == 16
    before = t._state()["held"]
    touched = t.upsert(rows(spark, [(7, 9), (11, 9), (5000, 9)]), {"n": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))})
    after = t._state()["held"]
    assert touched <= 3 and sum(before[b] != after[b] for b in before) == touched
    assert t.read().count() == 2001 and {k: n for k, n in held(t) if n != 1} == {7: 10, 11: 10, 5000: 9}
    assert t.read(1).count() == 2000  # readers of the version before keep it


def test_nulls_partial_columns_and_deletes(spark):
    t = table(spark, 4)
    t.insert(rows(spark, [(1, 1), (None, 2), (None, 3), (1, 4)]).dropDuplicates(["k"]))
    assert t.upsert(spark.createDataFrame([(None, 7)], "k bigint, n int")) == 1
    assert {(r.k, r.name, r.n) for r in t.read().filter("k IS NULL").collect()} == {(None, "nNone", 7)}
    t.delete(spark.createDataFrame([(None,), (99,)], "k bigint"))
    assert [k for k, _ in held(t)] == [1] and t.delete(t.read().select("k")) == 1 and held(t) == []
    assert t.upsert(rows(spark, [])) == 0 and held(t) == []


def test_batches_that_are_tried_again_count_once(spark):
    t, add = table(spark, 4), {"n": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    for number in (0, 0, 1, 1, 0):
        t.upsert(rows(spark, [(1, 5)]), add, ("w", number))
    assert held(t) == [(1, 10)]
    t.upsert(rows(spark, [(1, 5)]), add, ("other", 0))
    assert held(t) == [(1, 15)]


def test_a_failed_write_has_no_effect(spark):
    t = table(spark, 4)
    t.insert(rows(spark, [(1, 1)]))
    broken = rows(spark, [(1, 2)]).withColumn("n", F.when(F.col("k") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        t.upsert(broken)
    assert held(t) == [(1, 1)] and t.versions() == [1]
    t.upsert(rows(spark, [(2, 2)]))
    t.clean(keep=1)
    folders = {p.name for p in (pathlib.Path(t.path.removeprefix("file://")) / "data").iterdir()}
    assert folders == set(t._state()["held"].values()) and held(t) == [(1, 1), (2, 2)] and t.versions() == [2]


def test_of_two_writers_one_must_write_again(spark):
    t = table(spark, 4)
    t.insert(rows(spark, [(1, 1)]))
    state = t._state()
    t.upsert(rows(spark, [(2, 2)]))
    with pytest.raises(WriteConflict):
        t._commit(state | {"version": state["version"] + 1})
    assert held(t) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        KeyedTable(spark, t.path, "key_bucket int", ["key_bucket"])
