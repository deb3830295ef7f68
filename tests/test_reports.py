"""Annotations, comparison reports, list orders, clients by location and specifications of a git reference."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from pactlens.operators import reports, rules, store
from pactlens.plans import flows
from pactlens.sources import specs

CHANGES = "pair int, ord int, change_id string, kind string, location string, verdict string, rule_id string, rationale string, affected_clients array<string>, before string, after string"


def changes(spark):
    rows = [
        (1, 1, "a1", "k.one", "/paths//a/get", "additive", "R1", "fine", None, None, '{"x":1}'),
        (1, 2, "a2", "k.two", '/paths//"q"', "breaking", "R2", None, ["one"], "5", None),
        (1, 3, "a3", "k.three", "/paths//é", "behavioral", "R3", "so, so", ["one", "two"], "bad", '"t"'),
        (2, 1, "b1", "k.one", "/x", "breaking", "R1", "no", [], None, None),
    ]
    return spark.createDataFrame(rows, CHANGES)


def test_check_annotations(spark):
    got = {(r.pair, r.position): r for r in reports.check_annotations(changes(spark), ["pair"], "ord", "api/spec.json").collect()}
    assert [got[1, i].annotation_level for i in (1, 2, 3)] == ["failure", "warning", "notice"]
    first, second = got[1, 1], got[1, 2]
    assert (first.path, first.start_line, first.end_line, first.title) == ("api/spec.json", 1, 1, "k.two [R2]")
    assert first.message == '/paths//"q":  (affects 1 client repo)' and second.message == "/paths//é: so, so (affects 2 client repos)"
    # The details are laid out as an indented JSON object in this order of members.
    want = {"change_id": "a3", "kind": "k.three", "location": "/paths//é", "verdict": "behavioral", "rule_id": "R3", "affected_clients": ["one", "two"]}
    assert second.raw_details == json.dumps(want, indent=2, ensure_ascii=False)
    assert json.loads(got[1, 3].raw_details)["affected_clients"] == [] and '"affected_clients": []' in got[1, 3].raw_details
    per_pair = reports.check_annotations(changes(spark), ["pair"], "ord", F.concat(F.lit("s"), F.col("pair").cast("string")), limit=1)
    assert sorted((r.pair, r.path) for r in per_pair.collect()) == [(1, "s1"), (2, "s2")]
    with pytest.raises(ValueError):
        reports.check_annotations(changes(spark), ["pair"], "ord", "")


def test_comparison_reports(spark):
    found = spark.createDataFrame([(1, 1, "b", "m2", 0, []), (1, 0, "a", 'm"1', 2, ["paths", "0"]), (2, 0, "p", "of a proto", 1, [])], "pair int, position int, code string, message string, severity bigint, path array<string>")
    comparisons = spark.createDataFrame([(1, "openapi"), (2, "proto"), (3, "openapi")], "pair int, contract_kind string")
    got = {r.pair: json.loads(r.report) for r in reports.comparison_reports(comparisons, changes(spark), found, ["pair"], "ord", "mine").collect()}
    assert [c["change_id"] for c in got[1]["changes"]] == ["a1", "a2", "a3"] and got[1]["ruleset_id"] == "mine"
    assert [(c["before"], c["after"]) for c in got[1]["changes"]] == [(None, {"x": 1}), (5, None), ("bad", "t")]
    assert got[1]["changes"][0]["affected_clients"] == [] and got[1]["changes"][1]["rationale"] is None
    assert got[1]["spectral_findings"] == [{"code": "a", "message": 'm"1', "path": ["paths", "0"], "severity": 2}, {"code": "b", "message": "m2", "path": [], "severity": 0}]
    assert got[1]["summary"] == {"additive": 1, "behavioral": 1, "breaking": 1, "total": 3}
    assert got[2]["spectral_findings"] == [] and got[2]["contract_kind"] == "proto" and len(got[2]["changes"]) == 1
    assert got[3] == {"changes": [], "contract_kind": "openapi", "ruleset_id": "mine", "spectral_findings": [], "summary": {"additive": 0, "behavioral": 0, "breaking": 0, "total": 0}}


def test_orders_of_lists(spark):
    rows = [(2, "b"), (1, "c"), (1, "a"), (1, "a"), (1, "b"), (1, "c")]
    each = spark.createDataFrame([(p, "breaking", [c]) for p, c in rows], "pair int, verdict string, affected_clients array<string>")
    assert [(r.pair, r.client, r.changes) for r in reports.ranked_impact(each, ["pair"]).collect()] == [(1, "a", 2), (1, "c", 2), (1, "b", 1), (2, "b", 1)]
    listed = spark.createDataFrame([("x", 1), ("y", None), ("z", 3), ("w", 3)], "id string, at int")
    assert [r.id for r in store.newest_first(listed, "at", "id").collect()] == ["w", "z", "x", "y"]


def test_clients_by_location(spark):
    places = [
        ("/paths//a/{id}/get/responses/200/properties/get", "a"),
        ("/paths//get/post/requestBody", "b"),
        ("/paths//get/post/requestBody/properties/x/enum", "b"),
        ("/components/schemas/S/enum", None),
        ("/paths//a/{id}", None),
        ("/paths//a/{id}/delete", "d"),
    ]
    rows = [(i, p, None, None) for i, (p, _) in enumerate(places)] + [(9, "/paths//known/get/parameters/query/q", "/known", ["GET"])]
    sites = spark.createDataFrame([("a", "get", "/a/{id}"), ("b", "POST", "/get"), ("c", "GET", "/known"), ("d", "DELETE", "/a/{id}")], "repo string, method string, path_template string")
    asked = spark.createDataFrame(rows, "n int, location string, path string, methods array<string>")
    got = {r.n: r.affected_clients for r in rules.affected_clients(asked, sites, ["n"], by_location=True).collect()}
    assert got == {i: [c] if c else [] for i, (_, c) in enumerate(places)} | {9: ["c"]}
    plain = {r.n: r.affected_clients for r in rules.affected_clients(asked, sites, ["n"]).collect()}
    assert plain == dict.fromkeys(range(len(places)), []) | {9: ["c"]}


def test_known_batches_count_again_if_asked(spark):
    call = ("b1", "c", "GET", "https://h.example/a", None, '{"x":1}', "2024-05-01")
    calls = spark.createDataFrame([call, call], "batch_hash string, client_id string, method string, url string, request_body string, response_body string, at string").withColumn("ts", F.to_timestamp("at"))
    routes = spark.createDataFrame([("GET", "/a", 0)], "method string, path_template string, ord int")
    observed = spark.createDataFrame([], "method string, path_template string, sample_count bigint, last_seen_at timestamp, matched boolean, request_schema string, response_schema string")
    usage = spark.createDataFrame([], "method string, path_template string, client_id string, role string, path string, count bigint, json_types map<string,bigint>, last_seen_at timestamp")
    none = spark.createDataFrame([], "batch_hash string")
    first, fields, _ = flows.ingest_traffic(calls, routes, observed, usage, none)
    known = spark.createDataFrame([("b1",)], "batch_hash string")
    counts = lambda rows: [r.sample_count for r in rows.collect()]
    strict, again = (flows.ingest_traffic(calls, routes, first, fields, known, strict=s) for s in (True, False))
    assert (counts(first), counts(strict[0]), counts(again[0])) == ([2], [2], [4])
    assert {r.path: r["count"] for r in again[1].collect()} == {r.path: r["count"] for r in fields.collect()}
    assert (strict[2].first().records, again[2].first().records) == (0, 2)


def test_specification_of_a_git_reference(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ('{"v": 1}', '{"v": 2}', "[3]"):
        (tmp_path / "api.json").write_text(text)
        git("add", "api.json")
        git("commit", "-qm", text)
    read = lambda ref, path="api.json": specs.read_spec_at(spark, str(tmp_path), ref, path).collect()
    assert [(r.file, r.kind, r.spec, r.problem) for r in read("HEAD~1")] == [("HEAD~1:api.json", "openapi", '{"v": 2}', None)]
    assert read("HEAD~2")[0].spec == '{"v": 1}' and read("HEAD")[0].problem == "not a JSON object"
    for bad in (read("nowhere"), read("HEAD", "none.json"), read("--output=x")):
        assert [(r.spec, r.problem) for r in bad] == [(None, "not in the repository")]
