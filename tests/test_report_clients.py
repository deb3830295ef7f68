"""The Markdown reports of the registered query say which clients a change affects."""

from pyspark.sql import functions as F

from pactlens.operators import reports
from pactlens.plans import contracts


def test_report_markdown_names_its_clients(spark, tmp_path):
    spark.range(120).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    # Part 1 is removed, part 10 added, part 7 gets a required parameter; the other line items call by POST or use parts without changes of a method.
    lines = [(0, 3, 1, 5), (1, 3, 1, 4), (2, 6, 7, 4), (3, 3, 10, 40), (4, 3, 7, 4), (5, 1, 7, 9), (6, 3, 4, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.pair: r.report for r in contracts.report_markdown(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2]
    first = got[0].splitlines()
    assert first[first.index("### Clients") :] == ["### Clients", "", "| Client | Changes | Breaking |", "|---|---:|:---:|", "| `repo-4` | 3 | yes |", "| `repo-40` | 1 | no |", "| `repo-5` | 1 | yes |"]
    affected = {line.split("`")[1]: line.split("; affects ")[1] for line in first if "; affects " in line}
    assert affected == {"/paths//part/1": "`repo-4`, `repo-5`", "/paths//part/10": "`repo-40`", "/paths//part/7/get/parameters/query/size": "`repo-4`"}
    assert all(got[n].endswith("### Clients\n\nNo client is affected.") for n in (1, 2))


def test_reports_meet_their_clients_where_they_are(spark):
    rows = [(n, o, "k", "/x", "breaking", "R", "no", [f"c{o}", "c"]) for n in range(40) for o in range(3)]
    changes = spark.createDataFrame(rows, "pair int, ord int, kind string, location string, verdict string, rule_id string, rationale string, affected_clients array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reports.report_markdown(changes, ["pair"], "ord")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One deal for the lines and one for the clients, none after the texts were gathered.
    assert plan.count("REPARTITION_BY_NUM") == 2 == plan.count("Exchange hashpartitioning"), plan
