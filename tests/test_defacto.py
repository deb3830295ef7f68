"""The contract that traffic shows, against a plain overlay of dictionaries."""

import copy
import json
import random

from pactlens.operators import ingest

OBSERVED = "service string, method string, path_template string, request_schema string, response_schema string, sample_count bigint, last_seen_at string, matched boolean"
SCHEMAS = [None, "{}", "no JSON", "[1]", '{"type":"string"}', '{"type":"object","properties":{"p":{"type":"integer"}},"required":["p"]}', '{"type":"object","properties":{"q":{"type":"null"}}}']


def as_object(value):
    return value if isinstance(value, dict) else {}


def loaded(text):
    try:
        return as_object(json.loads(text or "{}"))
    except ValueError:
        return {}


def overlaid(spec, rows):
    """What the document must be, by plain assignment."""
    out = copy.deepcopy(as_object(spec))
    out.setdefault("openapi", "3.0.0")
    out.setdefault("info", {"title": "defacto", "version": "0.0.0"})
    paths = out["paths"] = as_object(out.get("paths"))
    static = set(paths)
    for _, method, path, request, response, count, at, matched in rows:
        if method is None or path is None:
            continue
        item = paths[path] = as_object(paths.get(path))
        op = item[method.lower()] = as_object(item.get(method.lower()))
        for schema, at_body in ((loaded(request), "requestBody"), (loaded(response), "responses")):
            if not schema:
                continue
            holder = op[at_body] = as_object(op.get(at_body))
            if at_body == "responses":
                holder["200"] = holder["200"] if isinstance(holder.get("200"), dict) else {"description": "observed"}
                holder = holder["200"]
            content = holder["content"] = as_object(holder.get("content"))
            media = content["application/json"] = as_object(content.get("application/json"))
            media["schema"] = ingest.merge_documents(as_object(media.get("schema")), schema)
        op["x-sample-count"], op["x-matched-static"] = count or 0, bool(matched)
        if at:
            op["x-last-seen-at"] = f"{at}T00:00:00+00:00"
        item["x-source"] = "both" if path in static else item.get("x-source", "observed")
    for item in paths.values():
        if isinstance(item, dict):
            item.setdefault("x-source", "static")
    return out


def random_spec(rng):
    def body():
        return rng.choice([{}, {"content": {}}, {"content": {"text/plain": {}}}, {"content": {"application/json": {"schema": json.loads(SCHEMAS[rng.randint(4, 6)]), "example": 1.5}}}, {"content": 4}, 7, None])

    def op():
        return rng.choice([{}, 5, None, {"tags": ['a"b', "é"]}, {"requestBody": body()}, {"responses": {"200": body(), "404": {}}}, {"responses": body()}])

    item = lambda: rng.choice([{}, 7, None, "text", {"get": op()}, {"get": op(), "post": op(), "parameters": [1]}, {"get": op(), "x-source": "mine"}])
    return rng.choice([{}, None, 3, {"paths": 4}, {"openapi": "3.1.0", "x": None}, *[{"info": {"title": "t"}, "paths": {f"/{c}": item() for c in "abcd"}} for _ in range(6)]])


def test_contract_equals_a_plain_overlay(spark):
    rng = random.Random(7)
    specs = {f"s{i}": random_spec(rng) for i in range(120)}
    rows = []
    for service in [*list(specs)[:100], "unknown", None]:
        endpoints = rng.sample([(m, p) for m in ("GET", "POST") for p in ("/a", "/b", "/e", "/f")], 4)
        rows += [(service, m, p, rng.choice(SCHEMAS), rng.choice(SCHEMAS), rng.choice([None, 3]), rng.choice([None, "2024-05-01"]), rng.choice([None, True, False])) for m, p in endpoints]
    rows += [("s0", None, "/a", None, None, 1, None, True), ("s0", "GET", None, None, None, 1, None, True)]
    # Two rows of one operation are laid on in the order of their columns.
    rows += [("twice", "GET", "/a", None, SCHEMAS[5], 9, "2024-05-01", True), ("twice", "get", "/a", None, SCHEMAS[6], 2, None, False)]
    found = ingest.defacto_contract(spark.createDataFrame([(k, json.dumps(v)) for k, v in specs.items()], "service string, spec string"), spark.createDataFrame(rows, OBSERVED), "service")
    got = {r.service: json.loads(r.contract) for r in found.collect()}
    assert set(got) == {*specs, "unknown", None, "twice"}
    for service, contract in got.items():
        assert contract == overlaid(specs.get(service), [r for r in rows if r[0] == service]), service


def test_contract_of_empty_tables_and_of_texts_that_are_none(spark):
    none = spark.createDataFrame([], OBSERVED)
    specs = spark.createDataFrame([("a", None), ("b", "[1]"), ("c", '{"paths":{"/a":{},"/a":{}}}'), ("d", "")], "service string, spec string")
    got = {r.service: json.loads(r.contract)["paths"] for r in ingest.defacto_contract(specs, none, "service").collect()}
    assert got == dict.fromkeys("abcd", {})
    assert ingest.defacto_contract(specs.limit(0), none, "service").count() == 0 and ingest.defacto_items(specs, none, "service").count() == 0


def test_one_service_with_very_many_endpoints(spark):
    n = 20_000
    seen = spark.range(n).selectExpr("'s' AS service", "'GET' AS method", "'/p/' || id AS path_template", "'{}' AS request_schema", "'{\"type\":\"string\"}' AS response_schema", "id AS sample_count", "'2024-05-01' AS last_seen_at", "true AS matched")
    specs = spark.createDataFrame([("s", json.dumps({"paths": {f"/p/{i}": {"get": {}} for i in range(0, n, 2)}}))], "service string, spec string")
    counts = {r.x_source: r["count"] for r in ingest.defacto_items(specs, seen, "service").groupBy("x_source").count().collect()}
    assert counts == {"both": n // 2, "observed": n // 2}
    assert len(json.loads(ingest.defacto_contract(specs, seen, "service").first().contract)["paths"]) == n
