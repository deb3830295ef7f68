"""Comparisons of specifications: tasks by bytes of text, and joins only for schemas that refer to a component."""

import json

from pyspark.sql import functions as F

from pactlens.operators import openapi_diff


def _spec(schema, **components):
    get = {"responses": {"200": {"content": {"application/json": {"schema": schema}}}}}
    return json.dumps({"paths": {f"/p{n}": {"get": get} for n in range(40)}, "components": {"schemas": components}})


def test_tasks_follow_the_bytes(spark, monkeypatch):
    before, after = {"properties": {"x": {"type": "string"}}}, {"properties": {"x": {"type": "integer"}}}
    rows = []
    for n in range(20):
        rows += [(n, "before", _spec({"$ref": "#/components/schemas/X"} if n % 2 else before, X=before)), (n, "after", _spec({"$ref": "#/components/schemas/X"} if n % 4 == 1 else after, X=after))]
    specs = spark.createDataFrame(rows, "pair int, side string, spec string")
    size = sum(len(r[2]) for r in rows)
    monkeypatch.setattr(openapi_diff, "TASK_BYTES", size // 16)
    changes = openapi_diff.diff_openapi(specs)
    got = {(r.pair, r.kind, r.location): r["count"] for r in changes.groupBy("pair", "kind", "location").count().collect()}
    assert got == {(n, "openapi.response.property.type_changed", f"/paths//p{k}/get/responses/200/properties/x"): 1 for n in range(20) for k in range(40)}
    # What a branch reads is never gathered in fewer tasks than the text needs.
    tasks = changes.select("pair", F.spark_partition_id().alias("task")).groupBy("task").count()
    assert tasks.count() >= 16
