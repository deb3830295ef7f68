"""Lists of clients are gathered in tasks by the number of clients found, not by the text of the changes alone."""

from pyspark.sql import functions as F

from pactlens.functions import lineage
from pactlens.operators import rules


def test_tasks_follow_the_clients(spark, monkeypatch):
    shape = "pair int, ord int, path string, methods array<string>"
    changes = spark.createDataFrame([(p, o, f"/p{o}", ["GET"]) for p in range(20) for o in range(5)] + [(99, 0, None, None)], shape)
    sites = spark.range(400).select(F.lit("get").alias("method"), F.concat(F.lit("/p"), (F.col("id") % 4).cast("string")).alias("path_template"), F.concat(F.lit("r"), F.floor(F.col("id") / 8).cast("string")).alias("repo"))
    monkeypatch.setattr(lineage, "TASK_ROWS", 400)
    found = rules.affected_clients(changes, sites, ["pair", "ord"], tasks=4)
    every = sorted(f"r{n}" for n in range(50))
    assert {(r.pair, r.ord): r.affected_clients for r in found.collect()} == {(p, o): every if o < 4 else [] for p in range(20) for o in range(5)} | {(99, 0): []}
    # 80 changes with 50 clients each.
    held = found.select(F.spark_partition_id().alias("task"), F.size("affected_clients").alias("n")).groupBy("task").agg(F.sum("n").alias("n")).collect()
    assert found.rdd.getNumPartitions() == 10 and max(r.n for r in held) < 4000 / 2
