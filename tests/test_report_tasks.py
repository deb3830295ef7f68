"""Comparisons, reports and guides work on no more than TASK_BYTES of text in a task."""

from pyspark.sql import functions as F

from pactlens.functions import lineage
from pactlens.operators import guides, reports
from pactlens.plans import contracts


def _tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def test_tasks_follow_the_bytes(spark, monkeypatch, tmp_path):
    parts = spark.range(2000).select(F.col("id").alias("p_partkey"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(4000).select(F.col("id").alias("l_orderkey"), F.lit(3).alias("l_linenumber"), (F.col("id") % 2000).alias("l_partkey"), (F.col("id") % 50).alias("l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = {(r.pair, r.ord): r for r in contracts.diffed(spark, str(tmp_path)).collect()}
    whole = {r.pair: r.report for r in reports.report_json(contracts.diffed(spark, str(tmp_path)), ["pair"], "ord").collect()}

    monkeypatch.setattr(lineage, "TASK_BYTES", 10_000)
    monkeypatch.setattr(contracts, "TASK_PARTS", 100)
    assert _tasks(contracts.openapi_pairs(spark, str(tmp_path))) > 10
    changes = contracts.diffed(spark, str(tmp_path))
    assert _tasks(changes) > 10
    assert {(r.pair, r.ord): r for r in changes.collect()} == plain
    texts = reports.report_json(changes, ["pair"], "ord")
    assert {r.pair: r.report for r in texts.collect()} == whole
    for report in (texts, reports.report_text(changes, ["pair"], "ord"), reports.report_markdown(changes, ["pair"], "ord")):
        assert _tasks(report) > 10
    asked = spark.range(40).select(F.lit("repo-1").alias("client_id"), F.col("id").alias("diff_id"))
    sites = spark.createDataFrame([], "repo string, file string, line int, method string, path_template string")
    assert _tasks(guides.guide_context(changes.withColumnRenamed("pair", "diff_id"), sites, asked)) > 10
