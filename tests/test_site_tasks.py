"""Call sites are dealt out by number and bytes before the first of each repository are picked."""

from pyspark.sql import functions as F

from pactlens.functions import lineage
from pactlens.operators import guides


def test_first_call_sites_are_dealt_out(spark, monkeypatch):
    rows = [("big" if n % 2 else f"r{n % 30}", f"f{n * 7 % 1000:03d}", n % 9, "GET", f"/p{n}") for n in range(2000)]
    sites = spark.createDataFrame(rows, "repo string, file string, line int, method string, path_template string").coalesce(1)
    want = {}
    for r in sorted(rows, key=lambda r: r[1:]):
        want.setdefault(r[0], []).append(r)
    want = {r + (n,) for own in want.values() for n, r in enumerate(own[:10], 1)}

    def check(tasks):
        first = guides.first_call_sites(sites)
        assert first.columns == [*sites.columns, "position"] and {tuple(r) for r in first.collect()} == want
        assert first.rdd.getNumPartitions() == tasks
        # What is read is not ranked where it is read: below the lowest window the rows are dealt out by repository and share.
        plan = first._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("RepartitionByExpression") > plan.rindex("Window")

    check(4)
    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    check(20)
    monkeypatch.setattr(lineage, "TASK_ROWS", 500_000)
    monkeypatch.setattr(lineage, "TASK_BYTES", 1000)
    check(-(-sum(len(r[1]) + 1 + len(r[3]) + len(r[4]) for r in rows) // 1000))
