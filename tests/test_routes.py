"""Routes of many services against a tree walked in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pactlens.operators import routes

SHAPE = "service string, method string, path_template string, ord int"


def plain_match(rows, service, method, path):
    tree = {}
    for s, m, template, order in rows:
        if s == service:
            node = tree
            for part in filter(None, template.split("/")):
                node = node.setdefault(True if re.fullmatch(r"\{[^}]+\}", part) else part, {})
            node.setdefault(None, []).append((order, template, m.upper()))
    node = tree
    for part in filter(None, path.split("/")):
        node = node.get(part) or node.get(True)
        if node is None:
            return None
    ends = node.get(None, [])
    return max(ends)[1] if method.upper() in {m for _, _, m in ends} else None


@pytest.mark.parametrize("limit", [10_000, 0])
def test_walks_of_many_services(spark, monkeypatch, limit):
    monkeypatch.setattr(routes, "BROADCAST_ROUTES", limit)
    r = random.Random(4)
    parts = ["a", "b", "{x}", "{y}", "{}", "7", "{a}b"]
    rows = [(f"s{r.randrange(4)}", r.choice(["GET", "post"]), "/" + "/".join(r.choice(parts) for _ in range(r.randrange(5))), n) for n in range(60)]
    calls = [(n, f"s{r.randrange(5)}", r.choice(["get", "POST"]), "http://h/" + "/".join(r.choice(["a", "b", "7", "z"]) for _ in range(r.randrange(6)))) for n in range(400)]
    calls += [(900, "s1", "GET", None), (901, None, "GET", "/a"), (902, "s1", None, "/a"), (903, "s0", "GET", "/a//b/?q"), (903, "s0", "GET", "/a//b/?q")]
    df = spark.createDataFrame(calls, "n int, service string, method string, url string")
    for clash in ("node", "chain", "walk_step", "walk_path", "walk_node", "segment", "path_template"):
        df = df.withColumn(clash, F.lit("kept"))
    got = routes.match_routes(df, spark.createDataFrame(rows, SHAPE), keys=("service",))
    assert set(df.columns) | {"matched"} == set(got.columns)
    found = got.collect()
    assert len(found) == len(calls) and all(g.node == g.walk_step == g.segment == "kept" for g in found)
    urls = {n: (s, m, u) for n, s, m, u in calls}
    for g in found:
        s, m, u = urls[g.n]
        want = plain_match(rows, s, m, u.split("://h")[-1].split("?")[0]) if s and m and u else None
        assert g.matched == (want is not None) and (want is None or g.path_template == want), (g, want)
    assert {g.n: g.path_template for g in found}[900] is None


def test_a_hundred_thousand_routes(spark):
    made = spark.range(100_000).select(
        (F.col("id") % 1000).cast("string").alias("service"), F.lit("GET").alias("method"),
        F.concat(F.lit("/v1/r"), (F.col("id") % 5000).cast("string"), F.when(F.col("id") % 2 == 0, "/{id}").otherwise("/{id}/x")).alias("path_template"), F.col("id").cast("int").alias("ord"),
    )
    calls = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("service"), F.lit("GET").alias("method"), F.concat(F.lit("/v1/r"), (F.col("id") % 5000).cast("string"), F.lit("/42")).alias("url"))
    got = routes.match_routes(calls, made, keys=("service",))
    assert got.filter("matched").count() == 1000 and got.count() == 2000


def test_no_routes_and_no_calls(spark):
    none = spark.createDataFrame([], SHAPE)
    calls = spark.createDataFrame([("s", "GET", "/a/1")], "service string, method string, url string")
    assert [(r.path_template, r.matched) for r in routes.match_routes(calls, none, keys=("service",)).collect()] == [("/a/{id}", False)]
    assert routes.match_routes(calls.limit(0), none).count() == 0
