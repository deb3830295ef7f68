"""Base operators against hand-derived results, invariants and the SQL of the catalogue."""

import json
import os

import duckdb
import pandas as pd
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.functions import decay, identity, jsontree, paths
from pactlens.functions.times import iso_time
from pactlens.operators import campaigns, guides, ingest, mining, openapi_diff, proto_diff, reports, routes, rules, store
from pactlens.plans import catalogue, contracts, documents, registry  # noqa: F401
from pactlens.sources import code, specs, traffic
from tests.conftest import SF

NOW = "2024-05-01 00:00:00"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.register(name.split(".")[0], ds.dataset(f"{SF}/{name}").to_table())
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(got), plain(want))


def test_stream_batches_are_folded(spark, tmp_path):
    from pactlens.streaming.usage import endpoints_by_stream

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.path_template: (r.sample_count, r.last_seen_at, r.matched) for r in endpoints_by_stream(spark, str(tmp_path), files_per_batch=1).collect()}
    want = ingest.observed_endpoints(catalogue.calls(spark, SF)).collect()
    assert got == {r.path_template: (r.sample_count, r.last_seen_at, r.matched) for r in want}


def test_paths(spark):
    rows = [
        ("https://h.example/a/7//b?x=1#f", "/a/{id}//b"),
        ("https://h.example", "/"),
        ("a/0f8fad5b-d9cb-469f-a165-70867728950e?q", "/a/{id}"),
        ("/v1/12x/9", "/v1/12x/{id}"),
    ]
    df = spark.createDataFrame(rows, "url string, want string")
    out = df.select("want", paths.abstract_static_segments(paths.strip_to_path(F.col("url"))).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]
    again = df.select(paths.abstract_static_segments(F.col("want")).alias("t"), "want").collect()
    assert all(r.t == r.want for r in again)
    t = paths.normalize_template(F.col("raw"), F.col("names"))
    raw = [("http://h/u/\x00/p/\x00/\x00?q=\x00", ["id", "id", ""]), ("x//\x00/", ["a"]), ("http://h", []), ("/", [])]
    got = [r.t for r in spark.createDataFrame(raw, "raw string, names array<string>").select(t.alias("t")).collect()]
    assert got == ["/u/{id}/p/{id2}/{param}", "/x/{a}", "/", "/"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab*?[!]/.", max_size=8), st.text(alphabet="ab/.[", max_size=8))
def test_globs(glob, text):
    import fnmatch
    import re

    pattern = paths.glob_to_regex(glob)
    assert bool(re.search(pattern.replace(r"\z", r"\Z"), text)) == fnmatch.fnmatchcase(text, glob)


def test_identities(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "é", "c": [1, 2]}',), ("{bad",), (None,)], "t string")
    got = [r.c for r in df.select(identity.canonical_json("t").alias("c")).collect()]
    assert got == [json.dumps({"b": 1.0, "a": "é", "c": [1, 2]}, sort_keys=True, separators=(",", ":")), None, None]
    one = spark.range(1)
    h = lambda *f: one.select(identity.call_site_hash(F.lit("a.py"), F.lit(3), F.lit("python"), F.lit("requests"), F.lit("get"), F.lit("/x"), F.array(*map(F.lit, f))).alias("h")).first().h
    assert h("a", "b") == h("b", "a") != h("a")
    key = lambda *x: one.select(identity.guide_key(*map(F.lit, x)).alias("h")).first().h
    assert key("a|b", "c", "v", "m") == key("a", "b|c", "v", "m")


def test_traffic_sources(spark):
    entry = lambda **k: {"startedDateTime": "2024-01-02T03:04:05Z", "request": {"method": "get", "url": "http://h/a/1", "headers": [{"name": "X", "value": "1"}, {"name": "x", "value": "2"}], "queryString": [{"name": "q"}], **k}, "response": {"status": "abc", "content": {"text": '{"a": 1}'}}}
    har = json.dumps({"log": {"entries": [entry(), entry(method=None), entry(postData={"text": "not json"})]}})
    now = F.lit(NOW).cast("timestamp")
    got = traffic.har_calls(spark.createDataFrame([(har,), ("",), (None,)], "content string"), now).collect()
    assert len(got) == 2 and got[0].method == "GET" and got[0].status == 0 and got[0].request_headers == {"x": "2"} and got[0].query == {"q": ""}
    assert got[0].response_body == '{"a": 1}' and got[1].request_body is None and str(got[0].ts) == "2024-01-02 03:04:05"
    for bad in ("{nope", '{"other": 1}'):
        with pytest.raises(Exception, match="not a HAR document"):
            traffic.har_calls(spark.createDataFrame([(bad,)], "content string"), now).collect()
    lines = ['{"path": "/s/M", "request": {"a": 1}, "status": 3}', '{"method_path": "/s/N", "method": "x", "timestamp": "junk"}', "", "[1]", "{bad", '{"method": "no path"}']
    got = traffic.grpc_calls(spark.createDataFrame([(x,) for x in lines], "value string"), now).orderBy("url").collect()
    assert [(g.method, g.url, g.status) for g in got] == [("POST", "/s/M", 3), ("X", "/s/N", 0)] and json.loads(got[0].request_body) == {"a": 1} and str(got[1].ts) == NOW


def test_routes_are_greedy(spark):
    table = spark.createDataFrame([("GET", "/users/me/x", 0), ("GET", "/users/{id}/y", 1), ("GET", "/users/{name}", 2), ("POST", "/users/{id}", 3), ("GET", "/", 4)], "method string, path_template string, ord int")
    rows = [("GET", "http://h/users/me/y"), ("GET", "/users/7/y?a"), ("get", "/users/7"), ("POST", "/users/7"), ("PUT", "/users/7"), ("GET", "/"), ("GET", "/none/5")]
    got = routes.match_routes(spark.createDataFrame(rows, "method string, url string"), table)
    got = {(r.method, r.url): (r.path_template, r.matched) for r in got.collect()}
    assert list(got[r] for r in rows) == [
        ("/users/me/y", False), ("/users/{id}/y", True), ("/users/{id}", True), ("/users/{id}", True), ("/users/{id}", False), ("/", True), ("/none/{id}", False),
    ]


def test_schemas(spark):
    bodies = ['{"id": 1, "tag": "a", "items": [{"n": 1}, {"n": "x"}]}', '{"id": 2, "tag": "b"}', '{"id": null, "tag": "a"}', '{"id": 1.5, "tag": "b"}', None, "{bad"]
    calls = spark.createDataFrame([("e", b) for b in bodies], "endpoint string, body string").withColumn("ts", F.lit(NOW).cast("timestamp"))
    schema = json.loads(ingest.infer_schemas(calls, ("endpoint",), {"request": "body"}).first().schema)
    assert schema["properties"]["id"] == {"type": ["integer", "null", "number"]} and schema["properties"]["tag"] == {"type": "string", "enum": ["a", "b"]}
    assert schema["required"] == ["id", "tag"] and schema["properties"]["items"]["items"]["properties"]["n"]["type"] == ["integer", "string"]
    assert [n[:3] for n in jsontree.walk({"a": [1, None]})] == [("$", "object", None), ("$.a", "array", None), ("$.a[*]", "integer", None), ("$.a[*]", "null", None)]
    deep = [json.dumps({"a.b": 1, "q\"": [[{"x": None}], "s"]}), "[1]", json.dumps({"a": {"b": True}}), "[" * 12 + "]" * 12]
    rows = spark.createDataFrame([(str(n % 2), b) for n, b in enumerate(deep)], "endpoint string, body string").withColumn("ts", F.lit(NOW).cast("timestamp"))
    got = {r.endpoint: json.loads(r.schema) for r in ingest.infer_schemas(rows, ("endpoint",), {"request": "body"}).collect()}
    zero = got["0"]["properties"]
    assert zero["a.b"] == {"type": "integer"} and zero["a"]["properties"] == {"b": {"type": "boolean"}} and "required" not in got["0"]
    assert zero['q"']["items"]["type"] == ["array", "string"] and zero['q"']["items"]["items"]["properties"]["x"] == {"type": "null"}
    assert got["1"]["type"] == ["array", "object"] and got["1"]["items"]["type"] == ["array", "integer"]


_SCHEMA = st.recursive(
    st.fixed_dictionaries({"type": st.sampled_from(["string", "integer"])}),
    lambda s: st.fixed_dictionaries({"type": st.just("object"), "properties": st.dictionaries(st.sampled_from("abc"), s, max_size=3)}, optional={"required": st.lists(st.sampled_from("abc"), max_size=2, unique=True).map(sorted)}),
    max_leaves=6,
)


@settings(max_examples=80, deadline=None)
@given(_SCHEMA, _SCHEMA)
def test_schema_merge(a, b):
    assert ingest.merge_documents(a, a) == a and ingest.merge_documents({}, a) == a
    both = ingest.merge_documents(a, b)
    if a["type"] == b["type"] == "object":
        assert set(both["properties"]) == set(a["properties"]) | set(b["properties"])
        if "required" in a and "required" in b:
            assert both["required"] == sorted(set(a["required"]) & set(b["required"]))
    else:
        assert both["type"] == b["type"]


def test_defacto_contract(spark):
    spec = json.dumps({"openapi": "3.1.0", "paths": {"/a": {"get": {}}, "/b": {}}})
    seen = [("s", "GET", "/a", "{}", '{"type":"object","properties":{}}', 3, NOW, True), ("s", "POST", "/c", '{"type":"object"}', "{}", 1, NOW, False)]
    observed = spark.createDataFrame(seen, "service string, method string, path_template string, request_schema string, response_schema string, sample_count bigint, last_seen_at string, matched boolean")
    specs = spark.createDataFrame([("s", spec), ("t", None)], "service string, spec string")
    got = {r.service: json.loads(r.contract) for r in ingest.defacto_contract(specs, observed, "service").collect()}
    p = got["s"]["paths"]
    assert [p[x]["x-source"] for x in ("/a", "/b", "/c")] == ["both", "static", "observed"] and got["t"]["paths"] == {}
    assert p["/a"]["get"]["responses"]["200"]["content"]["application/json"]["schema"]["type"] == "object" and p["/c"]["post"]["x-sample-count"] == 1


def spec_pair(before, after):
    return [(1, "before", json.dumps(before)), (1, "after", json.dumps(after))]


def operation(**k):
    return {"paths": {"/p": {"post": {"responses": {}, **k}}}}


def body(schema):
    return {"requestBody": {"content": {"application/json": {"schema": schema}}}}


def answer(schema, code="200"):
    return {"responses": {code: {"content": {"application/json": {"schema": schema}}}}}


def props(required=(), **p):
    return {"type": "object", "properties": p, "required": list(required)}


S, N = {"type": "string"}, {"type": "integer"}
OPENAPI_CASES = [
    ({"paths": {}}, {"paths": {"/p": {"get": {}}}}, {("openapi.path.added", "/paths//p")}),
    ({"paths": {"/p": {"get": {}}}}, {}, {("openapi.path.removed", "/paths//p")}),
    ({"paths": {"/p": {"get": {}}}}, {"paths": {"/p": {"post": {}}}}, {("openapi.operation.added", "/paths//p/post"), ("openapi.operation.removed", "/paths//p/get")}),
    (operation(parameters=[]), operation(parameters=[{"name": "a", "required": True}, {"name": "b", "in": "header"}]), {("openapi.parameter.added.required", "/paths//p/post/parameters/query/a"), ("openapi.parameter.added.optional", "/paths//p/post/parameters/header/b")}),
    (operation(parameters=[{"name": "a", "schema": S}]), operation(parameters=[{"name": "a", "required": True, "schema": N}]), {("openapi.parameter.required.increased", "/paths//p/post/parameters/query/a"), ("openapi.parameter.type_changed", "/paths//p/post/parameters/query/a")}),
    (operation(parameters=[{"name": "a", "required": True}, {"name": "z"}]), operation(parameters=[{"name": "a"}]), {("openapi.parameter.required.decreased", "/paths//p/post/parameters/query/a"), ("openapi.parameter.removed", "/paths//p/post/parameters/query/z")}),
    (operation(**body(props(a=S, b=S, c=S))), operation(**body(props(["c", "d"], a=N, c=S, d=S, e=S))), {
        ("openapi.request_body.property.type_changed", "/paths//p/post/requestBody/properties/a"), ("openapi.request_body.property.removed", "/paths//p/post/requestBody/properties/b"),
        ("openapi.request_body.property.required.increased", "/paths//p/post/requestBody/properties/c"), ("openapi.request_body.property.added.required", "/paths//p/post/requestBody/properties/d"),
        ("openapi.request_body.property.added.optional", "/paths//p/post/requestBody/properties/e")}),
    (operation(requestBody={"required": True}), operation(requestBody={}), {("openapi.request_body.property.required.decreased", "/paths//p/post/requestBody")}),
    (operation(**answer({}, "200")), operation(**answer({}, "201")), {("openapi.response.added", "/paths//p/post/responses/201"), ("openapi.response.removed", "/paths//p/post/responses/200")}),
    (operation(**answer(props(a=S, b=S))), operation(**answer(props(a=N, c=S))), {("openapi.response.property.type_changed", "/paths//p/post/responses/200/properties/a"), ("openapi.response.property.removed", "/paths//p/post/responses/200/properties/b"), ("openapi.response.property.added", "/paths//p/post/responses/200/properties/c")}),
    ({**operation(**answer({"$ref": "#/components/schemas/T"})), "components": {"schemas": {"T": props(a=S)}}}, {**operation(**answer({"$ref": "#/components/schemas/T"})), "components": {"schemas": {"T": props(a=N)}}}, {("openapi.response.property.type_changed", "/paths//p/post/responses/200/properties/a")}),
    ({"components": {"schemas": {"E": {"enum": ["a", 1]}}}}, {"components": {"schemas": {"E": {"enum": ["a", "1"]}}}}, {("openapi.enum.value.added", "/components/schemas/E/enum"), ("openapi.enum.value.removed", "/components/schemas/E/enum")}),
    (operation(**body(props(a={"type": "string", "enum": ["x"]}))), operation(**body(props(a={"type": "string", "enum": ["x", "it's"]}))), {("openapi.enum.value.added", "/paths//p/post/requestBody/properties/a/enum")}),
]


def test_openapi_changes(spark):
    rows = []
    for n, (before, after, _) in enumerate(OPENAPI_CASES):
        rows += [(n, "before", json.dumps(before)), (n, "after", json.dumps(after)), (100 + n, "before", json.dumps(after)), (100 + n, "after", json.dumps(after))]
    got = openapi_diff.diff_openapi(spark.createDataFrame(rows, "pair int, side string, spec string")).collect()
    for n, (_, _, want) in enumerate(OPENAPI_CASES):
        assert {(g.kind, g.location) for g in got if g.pair == n} == want, n
    assert not [g for g in got if g.pair >= 100]
    assert {g.after for g in got if g.pair in (11, 12) and g.kind.endswith("added")} == {"'1'", '"it\'s"'}
    assert [g.methods for g in got if g.kind == "openapi.path.removed"] == [["GET"]]


def descriptors(messages, services=()):
    from google.protobuf import descriptor_pb2 as pb

    file = pb.FileDescriptorProto(name="f.proto", package="pkg")
    for name, fields in messages.items():
        m = file.message_type.add(name=name)
        for number, (f, kind, label) in fields.items():
            m.field.add(name=f, number=number, type=kind, label=label)
    for name, methods in dict(services).items():
        s = file.service.add(name=name)
        for m, (i, o) in methods.items():
            s.method.add(name=m, input_type=i, output_type=o)
    return pb.FileDescriptorSet(file=[file]).SerializeToString()


def test_proto_changes(spark):
    before = descriptors({"A": {1: ("x", 9, 1), 2: ("y", 9, 1), 3: ("z", 9, 1), 4: ("w", 9, 1), 5: ("v", 9, 1)}, "Gone": {}}, {"S": {"M": (".A", ".A"), "N": (".A", ".A")}, "Old": {}})
    after = descriptors({"A": {1: ("x", 5, 1), 2: ("y", 9, 3), 3: ("zz", 9, 1), 14: ("w", 9, 1), 6: ("u", 9, 1)}, "New": {}}, {"S": {"M": (".B", ".C"), "O": (".A", ".A")}, "Young": {}})
    df = spark.createDataFrame([(1, "before", bytearray(before)), (1, "after", bytearray(after)), (2, "before", bytearray(after)), (2, "after", bytearray(after))], "pair int, side string, descriptors binary")
    got = proto_diff.diff_proto(df).collect()
    assert {(g.kind, g.location) for g in got} == {
        ("proto.message.added", "/messages/pkg.New"), ("proto.message.removed", "/messages/pkg.Gone"), ("proto.service.added", "/services/pkg.Young"), ("proto.service.removed", "/services/pkg.Old"),
        ("proto.field.type_changed", "/pkg.A/x"), ("proto.field.label_changed", "/pkg.A/y"), ("proto.field.renamed", "/pkg.A/z"), ("proto.field.number_changed", "/pkg.A/w"),
        ("proto.field.removed", "/pkg.A/v"), ("proto.field.added", "/pkg.A/u"), ("proto.rpc.added", "/pkg.S/O"), ("proto.rpc.removed", "/pkg.S/N"),
        ("proto.rpc.request_type_changed", "/pkg.S/M"), ("proto.rpc.response_type_changed", "/pkg.S/M"),
    }
    assert all(g.pair == 1 for g in got) and {g.path for g in got if g.kind == "proto.rpc.removed"} == {"pkg.S.N"}


def test_rules_and_reports(spark):
    own = rules.load_rules("rules:\n  - {id: X, kind: openapi.path.removed, verdict: additive, location_glob: '/paths//int*'}\n  - {id: OAS-PATH-ADDED, kind: openapi.path.added, verdict: behavioral}")
    with pytest.raises(ValueError):
        rules.load_rules("[1]")
    with pytest.raises(ValueError):
        rules.rule_rows([{"id": "a", "kind": "b", "verdict": "c"}])
    merged = rules.combine_rules(rules.default_rules(), own)
    assert len(merged) == len(rules.DEFAULT_RULES) + 1 and merged[0]["verdict"] == "behavioral" and rules.combine_rules(merged, own, "replace") == own
    rows = [(0, "openapi.path.removed", "/paths//internal", "/internal", ["GET"]), (1, "openapi.path.removed", "/paths//u/{id}", "/u/{id}", ["GET", "POST"]), (2, "openapi.path.added", "/paths//n", "/n", ["GET"]), (3, "mystery", "/x", None, None)]
    changes = spark.createDataFrame(rows, "ord int, kind string, location string, path string, methods array<string>")
    got = rules.classify(changes, rules.rule_table(spark, merged), ["ord"])
    assert [(r.rule_id, r.verdict) for r in got.orderBy("ord").collect()] == [("X", "additive"), ("OAS-PATH-REMOVED", "breaking"), ("OAS-PATH-ADDED", "behavioral"), ("UNCLASSIFIED", "behavioral")]
    sites = spark.createDataFrame([("r2", "get", "/u/{id}"), ("r1", "POST", "/u/{id}"), ("r1", "GET", "/u/{id}"), ("r3", "GET", "/u/{user}")], "repo string, method string, path_template string")
    hit = rules.affected_clients(got, sites, ["ord"])
    assert [r.affected_clients for r in hit.orderBy("ord").collect()] == [[], ["r1", "r2"], [], []]
    assert [r.affected_clients for r in rules.affected_clients(got, sites, ["ord"], erase_names=True).orderBy("ord").collect()][1] == ["r1", "r2", "r3"]
    hit = hit.withColumn("diff_id", F.lit("a")).cache()
    summary = reports.verdict_summary(hit, ["diff_id"]).first()
    assert summary.total == 4 == summary.breaking + summary.behavioral + summary.additive and summary.breaking == 1
    text = reports.report_text(hit, ["diff_id"], "ord").first().report
    assert text.startswith("breaking=1 behavioral=2 additive=1 total=4") and "(affects: r1, r2)" in text and text.index("breaking (1)") < text.index("behavioral (2)")
    page = reports.report_markdown(hit, ["diff_id"], "ord").first().report
    assert "| `r1` | 1 | yes |" in page and "This change breaks clients" in page
    command = hit.filter("ord = 0").select(reports.workflow_command(F.lit("k"), F.lit("R"), F.lit("/l"), F.lit("a: 5%, b\n\r"), F.lit("breaking")).alias("c")).first().c
    assert command == "::error title=k [R]::/l: a%3A 5%25%2C b "
    context = guides.guide_context(hit, sites.withColumn("file", F.lit("f")).withColumn("line", F.lit(1)), spark.createDataFrame([("r1", "a"), ("r9", "a"), ("r1", "b")], "client_id string, diff_id string"))
    context = {(r.client_id, r.diff_id): ([c.ord for c in r.changes], len(r.call_sites or []), r.language) for r in context.collect()}
    assert context == {("r1", "a"): ([1, 2, 3], 2, "python"), ("r9", "a"): ([2, 3], 0, "python"), ("r1", "b"): ([], 2, "python")}


PY = '''
import requests, httpx as hx
from stubs import users_pb2_grpc
BASE = "https://api.example/v1"
def f(user_id, s):
    requests.get(f"{BASE}/users/{user_id}/posts/{s.post_id}", params={"page": 1})
    requests.request("delete", BASE + "/users/42")
    with hx.Client() as c:
        c.post("/orders/", json={"sku": 1, "n": 2})
    hx.AsyncClient().put("/x")
    stub = users_pb2_grpc.UsersStub(None)
    stub.GetUser(GetUserRequest(id=1, name="a"))
    requests.get(unknown)
    print("requests.get('/no')")
'''
JS = '''
import axios from "axios";
const BASE = "/api";
// fetch("/no")
fetch(`${BASE}/items/${item.id}`, { method: "POST", body: JSON.stringify({ a: 1, b }) });
fetch('/plain');
axios.get("/users/" + "7", { params: { q: 1 } });
axios.post(`/orders/${getId(x)}`, { sku: 1 });
axios({ url: "/cfg", method: "put", data: { z: 1 } });
other.get("/no");
'''


def test_mining(spark):
    files = spark.createDataFrame([("r", "c", "a.py", "python", PY), ("r", "c", "b.js", "javascript", JS), ("r", "c", "bad.py", "python", "def ("), ("r", "c", "n.py", "python", None)], "repo string, commit_sha string, file string, language string, content string")
    sites = mining.mine_call_sites(files)
    got = {(s.file, s.client_library, s.method, s.path_template, tuple(s.fields)) for s in sites.collect()}
    assert got == {
        ("a.py", "requests", "GET", "/v1/users/{user_id}/posts/{post_id}", ("page",)), ("a.py", "requests", "DELETE", "/v1/users/{id}", ()), ("a.py", "httpx", "POST", "/orders", ("n", "sku")),
        ("a.py", "httpx", "PUT", "/x", ()), ("a.py", "grpc", "RPC", "/users.Users/GetUser", ("id", "name")),
        ("b.js", "fetch", "POST", "/api/items/{id}", ("a", "b")), ("b.js", "fetch", "GET", "/plain", ()), ("b.js", "axios", "GET", "/users/{id}", ("q",)),
        ("b.js", "axios", "POST", "/orders/{getId}", ("sku",)), ("b.js", "axios", "PUT", "/cfg", ("z",)),
    }
    labels = spark.createDataFrame([("GET", "/plain"), ("PUT", "/x"), ("GET", "/missing")], "method string, path_template string")
    r = mining.recall(labels, sites, ["method", "path_template"]).first()
    assert (r.labels, r.hits) == (3, 2) and r.recall == pytest.approx(2 / 3)
    assert store.insert_counts(sites, sites, ["content_hash"]).first().inserted == 0


def test_source_trees(spark, tmp_path):
    for name in ("src/a.py", "src/b.tsx", "node_modules/c.js", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {(r.file, r.language) for r in code.read_tree(spark, f"file://{tmp_path}").collect()} == {("src/a.py", "python"), ("src/b.tsx", "typescript")}


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, None, 5, "a"), (2, "x", 6, "b")], "k int, c string, n int, s string")
    new = spark.createDataFrame([(1, None, 50, None), (3, "y", 7, "d"), (3, "y", 7, "d")], "k int, c string, n int, s string")
    assert [r.k for r in store.insert_absent(old, new, ["k", "c"]).collect()] == [3]
    merged = store.merge_by_key(old, new.distinct(), ["k", "c"], {"n": lambda a, b: F.coalesce(a, b), "s": lambda a, b: F.coalesce(b, a)})
    assert sorted((r.k, r.n, r.s) for r in merged.collect()) == [(1, 5, "a"), (2, 6, "b"), (3, 7, "d")]
    assert sorted((r.k, r.n, r.s) for r in store.patch(old, new.distinct(), ["k", "c"]).collect()) == [(1, 50, "a"), (2, 6, "b")]
    latest = store.latest_per_group(old.unionByName(new), ["k"], [F.desc("n")])
    assert sorted((r.k, r.n) for r in latest.collect()) == [(1, 50), (2, 6), (3, 7)]


def test_campaigns(spark):
    rows = [("a", "e", "active", 5.0, 30, 1000), ("b", "e", "decaying", 5.0, 30, 10000), ("c", "x", "active", 5.0, 30, 0), ("d", "e", "completed", 5.0, 30, 9)]
    c = spark.createDataFrame(rows, "id string, endpoint_id string, state string, usage_threshold_pct double, decay_window_days int, peak_usage bigint")
    use = [("e", "u1", "2024-04-20 00:00:00", 30), ("e", "u2", "2024-04-21 00:00:00", 10), ("e", "u3", "2024-01-01 00:00:00", 9999)]
    u = spark.createDataFrame(use, "endpoint_id string, client_id string, window_end string, request_count bigint").withColumn("window_end", F.col("window_end").cast("timestamp"))
    last = spark.createDataFrame([("a", 100.0)], "id string, ewma_value double")
    got = {r.id: r for r in campaigns.evaluate(c, u, last, F.lit(NOW).cast("timestamp")).collect()}
    assert (got["a"].usage_count, got["a"].client_count, got["a"].next_state) == (40, 2, "decaying") and got["a"].ewma_value == pytest.approx(round(2 / 31 * 40 + 29 / 31 * 100, 4))
    assert got["b"].next_state == "ready_to_remove" and got["b"].ewma_value == 40.0 and got["c"].next_state == "decaying" and got["d"].usage_count is None
    asked = spark.createDataFrame([("a", "start_decay", None), ("a", "complete", None), ("b", "abort", None)], "id string, trigger string, peak_usage bigint")
    moved = {(r.id, r.trigger): (r.next_state, r.problem is None) for r in campaigns.transition(c, asked).collect()}
    assert moved == {("a", "start_decay"): ("decaying", True), ("a", "complete"): ("active", False), ("b", "abort"): ("aborted", True)}
    due = campaigns.due_reminders(c, spark.createDataFrame([("e", "r1"), ("e", "r2")], "endpoint_id string, client_repo string"), spark.createDataFrame([("b", "r1")], "campaign_id string, client_repo string"))
    assert [(r.campaign_id, r.client_repo) for r in due.collect()] == [("b", "r2")]
    values = spark.createDataFrame([([1.0, 5.0, 3.0],), ([],)], "xs array<double>").select(decay.ewma(F.col("xs"), F.lit(3)).alias("e")).collect()
    assert [v.e for v in values] == [3.0, None]


def test_guides(spark):
    md = "text\n```py\nx = 1\n```\n```js\nf({a: [1]})\n```\n```yaml\na: b\n```\n"
    df = spark.createDataFrame([(md,), ("```python\ndef (\n```",), ("```ts\nf((\n```",), ("none",)], "md string")
    got = df.select(guides.check_fences(guides.fences(F.col("md"))).alias("c")).select("c.*").collect()
    assert [(g.total, g.validated, g.skipped) for g in got] == [(3, 2, 1), (1, 0, 0), (1, 0, 0), (0, 0, 0)] and [g.problem is None for g in got] == [True, False, False, True]
    frame = spark.createDataFrame([("\n".join(map(str, range(1, 21))), 3)], "t string, n int").select(guides.source_frame(F.col("t"), F.col("n")).alias("f")).first().f
    assert frame == "\n".join(map(str, range(1, 8)))


def test_spec_files_and_findings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.json", b'{"paths": {}}'), ("b.json", b"[1]"), ("c.JSON", b""), ("d.pb", b"\n\x00"), ("e.json", b"{broken")):
        (tmp_path / "in" / name).write_bytes(content)
    got = {r.file.split("/")[-1]: (r.kind, r.spec, r.descriptors and bytes(r.descriptors), r.problem) for r in specs.read_specs(spark, f"{tmp_path}/in").collect()}
    assert got == {
        "a.json": ("openapi", '{"paths": {}}', None, None),
        "b.json": ("openapi", None, None, "not a JSON object"),
        "d.pb": ("proto", None, b"\n\x00", None),
        "e.json": ("openapi", None, None, "not a JSON object"),
    }
    reports_ = [(1, None), (2, ""), (3, "{}"), (4, '[{"code":"a","message":"m","severity":1.5},{"code":"b","message":"m","severity":2,"path":[1,"x"]},null]'), (5, "[]")]
    found = specs.findings(spark.createDataFrame(reports_, "id int, report string"), ("id",)).collect()
    assert [tuple(r) for r in found] == [(4, 1, "b", "m", 2, ["1", "x"])]
    uploads = [("openapi", None), ("proto", ""), ("other", "{}"), (None, "{}"), ("proto", "Cg=="), ("openapi", ' {"a":1}')]
    out = specs.decode_uploads(spark.createDataFrame(uploads, "kind string, document string").withColumn("spec", F.lit(1))).collect()
    assert [r.problem for r in out] == ["no document", "not base64", "unknown kind", "unknown kind", None, None]
    assert bytes(out[4].descriptors) == b"\n" and out[5].spec == ' {"a":1}'


def test_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "pair int, report string")
    reports.write_reports(df, f"{tmp_path}/out", ["pair"])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/pair=1", wholetext=True).collect()) == ["a\nb\n"]
    context = spark.createDataFrame([("c", None, None, "python")], "client_id string, changes array<struct<verdict:string,kind:string,location:string,rule_id:string,rationale:string>>, call_sites array<struct<file:string,line:int,method:string,path_template:string,fields:array<string>>>, language string")
    prompt = guides.render_prompt(context, strict=True).first().prompt
    assert "- none for this client" in prompt and "- none found" in prompt and "literals only" in prompt


def test_broken_inputs_do_not_end_the_job(spark):
    good = descriptors({"M": {1: ("a", 9, 1)}})
    specs_ = spark.createDataFrame([(1, "before", good), (1, "after", b"\x00broken"), (2, "before", good), (2, "after", None), (3, "before", good), (3, "after", good)], "pair int, side string, descriptors binary")
    assert {(r.pair, r.kind) for r in proto_diff.diff_proto(specs_).collect()} == {(2, "proto.message.removed")}
    assert [tuple(r) for r in proto_diff.descriptor_problems(specs_).collect()] == [(1, "after", "not a descriptor set")]
    pairs = [("{broken", '{"type": "string"}'), ('{"type": "string"}', "[1]"), (None, "{"), ("[" * 5000, None)]
    merged = spark.createDataFrame(pairs, "a string, b string").select(ingest.merge_schemas("a", "b").alias("m")).collect()
    assert [m.m for m in merged] == ['{"type": "string"}', '{"type": "string"}', "{}", "{}"]
    times = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.5",), (None,)], "t string").select(iso_time(F.col("t")).alias("t")).collect()
    assert [t.t for t in times] == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.500000+00:00", None]
