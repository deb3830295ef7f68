"""Traffic rolled up: endpoints, field usage, enums, schemas and the de-facto contract."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.functions.jsontree import field_paths, quoted
from pactlens.functions.lineage import cut
from pactlens.functions.times import iso_time

#: A string field is an enum with 2 to 8 values, each seen twice on average.
ENUM_LIMIT, ENUM_REPEATS = 8, 2


def observed_endpoints(calls: DataFrame, by: tuple[str, ...] = ("method", "path_template")) -> DataFrame:
    """Sample count, latest time and whether any call matched, per endpoint."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("sample_count"), F.max("ts").alias("last_seen_at"), F.bool_or("matched").alias("matched")
    )


def ingest_summary(endpoints: DataFrame) -> DataFrame:
    """Endpoints, matched endpoints and records of a batch, in one row."""
    return endpoints.agg(
        F.count("*").alias("observed_endpoints"),
        F.count_if("matched").alias("matched_endpoints"),
        F.coalesce(F.sum("sample_count"), F.lit(0)).cast("bigint").alias("records"),
    )


def field_nodes(calls: DataFrame, keys: tuple[str, ...], bodies: dict[str, str]) -> DataFrame:
    """keys, ts, role, path, type, text: every node of every body; bodies maps role to column."""
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(col).alias("body")) for role, col in bodies.items()])
    each = calls.select(*keys, "ts", F.explode(roles).alias("b")).filter("b.body IS NOT NULL")
    return each.select(*keys, "ts", "b.role", F.explode(field_paths(F.col("b.body"))).alias("n")).select(*keys, "ts", "role", "n.*")


def field_usage(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Occurrences, type histogram and latest time of every field path."""
    by_type = nodes.groupBy(*keys, "role", "path", "type").agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    return by_type.groupBy(*keys, "role", "path").agg(
        F.sum("n").cast("bigint").alias("count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("json_types"),
        F.max("seen").alias("last_seen_at"),
    )


def enum_values(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """String paths that look like enums, with their sorted values.

    Values are counted one by one first, and only paths that have few are gathered, so a path with
    many values never meets in one group.
    """
    strings = nodes.filter("type = 'string'").groupBy(*keys, "role", "path", "text").agg(F.count("*").alias("n"))
    small = strings.groupBy(*keys, "role", "path").agg(F.count("*").alias("values"), F.sum("n").alias("total"))
    small = small.filter(f"values > 1 AND values <= {ENUM_LIMIT} AND total >= values * {ENUM_REPEATS}")
    return (
        strings.join(small.select(*keys, "role", "path"), [*keys, "role", "path"])
        .groupBy(*keys, "role", "path")
        .agg(F.array_sort(F.collect_list("text")).alias("enum"))
    )


def infer_schemas(calls: DataFrame, keys: tuple[str, ...], bodies: dict[str, str]) -> DataFrame:
    """keys, role, schema: a JSON Schema of the bodies of each endpoint and role.

    Statistics of each path are aggregated first; then schemas are folded into those of their
    parents, level by level from the deepest, so a task never holds more than the children of one
    node.  A type list is sorted; a property is required if every object that could hold it does; an
    array's items are one schema; roots that are no objects say so beside `object`.  Null, blank and
    invalid bodies count for nothing; an endpoint without others has no row.
    """
    nodes = field_nodes(calls, keys, bodies)
    at = [*keys, "role", "path", "parent", "name", "depth"]
    stats = nodes.groupBy(*at).agg(F.collect_set("type").alias("types"), F.count("*").alias("n"), F.count_if(F.col("type") == "object").alias("objects"))
    stats = cut(stats.join(enum_values(nodes, keys), [*keys, "role", "path"], "left"))
    deepest = stats.agg(F.max("depth")).first()[0] or 0
    empty = F.array().cast("array<struct<name:string,schema:string,n:bigint>>")
    below = stats.limit(0).select(*keys, "role", "path", empty.alias("props"), F.lit("").alias("items"))
    for depth in range(deepest, -1, -1):
        level = stats.filter(F.col("depth") == depth).join(below, [*keys, "role", "path"], "left")
        level = level.select(*keys, "role", "parent", "name", "n", _schema_of(F.coalesce("props", empty)).alias("schema"))
        if depth % 8 == 7:  # keeps the plan of deep bodies small
            level = cut(level)
        child = F.when(F.col("name").isNotNull(), F.struct("name", "schema", "n"))
        below = level.groupBy(*keys, "role", F.col("parent").alias("path")).agg(
            F.array_sort(F.collect_list(child)).alias("props"), F.max(F.when(F.col("name").isNull(), F.col("schema"))).alias("items")
        )
    return level.select(*keys, "role", "schema")


def _schema_of(props: Column) -> Column:
    """The JSON text of a node's schema, its members sorted, from its statistics and its children's schemas."""
    root = F.col("depth") == 0
    types = F.array_sort(F.when(root, F.array_union("types", F.array(F.lit("object")))).otherwise(F.col("types")))
    plain = F.get(types, F.lit(0))
    required = F.transform(F.filter(props, lambda p: p["n"] == F.col("objects")), lambda p: p["name"])
    listed = F.array_join(F.transform(props, lambda p: F.concat(quoted(p["name"]), F.lit(": "), p["schema"])), ", ")
    holds = F.array_contains(types, "object")
    parts = [
        F.when((F.size(types) == 1) & (plain == "string") & F.col("enum").isNotNull(), F.concat(F.lit('"enum": '), F.to_json("enum"))),
        F.when(F.col("items") != "", F.concat(F.lit('"items": '), F.col("items"))),
        F.when(holds, F.concat(F.lit('"properties": {'), listed, F.lit("}"))),
        F.when(holds & (F.size(required) > 0), F.concat(F.lit('"required": '), F.to_json(required))),
        F.concat(F.lit('"type": '), F.when(F.size(types) == 1, quoted(plain)).otherwise(F.to_json(types))),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def _object(text: str | None) -> dict:
    """The JSON object that a text holds, or an empty one."""
    try:
        found = json.loads(text) if text else {}
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def merge_documents(old: dict, new: dict) -> dict:
    """The pragmatic union of two schemas: objects by property, anything else with the new side on top."""
    if not old or not new:
        return dict(old or new or {})
    if old.get("type") != "object" or new.get("type") != "object":
        return {**old, **new}
    mine, theirs = old.get("properties") or {}, new.get("properties") or {}
    out = {**old, "properties": {k: merge_documents(mine.get(k) or {}, theirs.get(k) or {}) for k in sorted({*mine, *theirs})}}
    declared = [set(side["required"] or []) for side in (old, new) if "required" in side]
    if declared:
        out["required"] = sorted(set.intersection(*declared))
    return out


@F.pandas_udf(T.StringType())
def merge_schemas(old: pd.Series, new: pd.Series) -> pd.Series:
    """JSON texts of two schemas to that of their union; null, and what is no JSON object, counts as empty.  Not commutative: fold in batch order."""
    load = _object
    return pd.Series([json.dumps(merge_documents(load(a), load(b)), sort_keys=True) for a, b in zip(old, new)], dtype=object)


def defacto_paths(static_paths: DataFrame, observed: DataFrame) -> DataFrame:
    """path_template, x_source: whether a path is in the specification, in traffic or in both."""
    a = static_paths.select("path_template").distinct().withColumn("s", F.lit(True))
    b = observed.select("path_template").distinct().withColumn("o", F.lit(True))
    source = F.when(F.col("s") & F.col("o"), "both").when(F.col("s"), "static").otherwise("observed")
    return a.join(b, "path_template", "full_outer").select("path_template", source.alias("x_source"))


def defacto_items(specs: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, path_template, x_source, item: every path of each service, its operations with what traffic shows.

    specs(key, spec) holds one specification per key (of several the greatest text counts), observed(key,
    method, path_template, request_schema, response_schema, sample_count, last_seen_at, matched) the
    endpoints seen.  Operations meet in a shuffle by key, path and verb, and then by key and path, so
    that one service's paths spread over all tasks.  Rows of one operation are laid on in order of their columns; the last one's count
    and time stay.  Members that are no JSON objects where one is needed give way to one.  A
    specification that is no JSON object, or repeats a key, has no paths; endpoints without a method or
    a path, and schemas that are empty or no JSON objects, are left out.
    """
    paths = specs.select(key, F.explode(_members(F.try_parse_json("spec"), "$.paths")).alias("path_template", "raw"))
    item = _members(F.try_parse_json("raw"))
    none = F.create_map().cast("map<string,string>")
    listed = paths.select(key, "path_template", F.when(item.isNull(), F.col("raw")).alias("raw"), item.isNotNull().alias("is_item"), F.explode_outer(F.coalesce(item, none)).alias("verb", "operation"))
    entry = F.struct("method", "request_schema", "response_schema", F.coalesce("sample_count", F.lit(0)).cast("bigint").alias("n"), iso_time(F.col("last_seen_at")).alias("at"), F.coalesce("matched", F.lit(False)).alias("matched"))
    traffic = observed.filter("method IS NOT NULL AND path_template IS NOT NULL").select(key, "path_template", F.lower("method").alias("verb"), entry.alias("entry"))
    both = listed.unionByName(traffic, allowMissingColumns=True)
    operations = both.groupBy(key, "path_template", "verb").agg(
        F.max("raw").alias("raw"), F.bool_or("is_item").alias("is_item"), F.max("operation").alias("operation"), F.array_sort(F.collect_list("entry")).alias("seen")
    )
    found = _laid_over(operations).select(key, "path_template", "verb", "raw", "is_item", (F.size("seen") > 0).alias("is_seen"), "text")
    items = found.groupBy(key, "path_template").agg(
        F.max("raw").alias("raw"), F.bool_or("is_item").alias("is_item"), F.bool_or("is_seen").alias("is_seen"), F.map_from_entries(F.collect_list(F.when(F.col("verb").isNotNull(), F.struct("verb", "text")))).alias("verbs")
    )
    source = F.when(F.col("is_item").isNull(), "observed").when(F.col("is_seen"), "both").otherwise("static")
    own = F.when(source != "both", F.get(F.map_values(F.map_filter("verbs", lambda k, _: k == "x-source")), F.lit(0)))
    marked = _over(F.col("verbs"), {"x-source": F.coalesce(own, quoted(source))})
    text = F.when(F.coalesce("is_item", F.lit(True)) | F.col("is_seen"), _object_text(marked)).otherwise(F.col("raw"))
    return items.select(key, "path_template", source.alias("x_source"), text.alias("item"))


def defacto_contract(specs: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, contract: the specification of each service with what traffic shows laid over it, keys sorted.

    Takes what defacto_items takes and folds its items into one document per key; where a service's
    document is too large for one value, use those.
    """
    items = defacto_items(specs, observed, key).select(key, F.struct("path_template", "item").alias("entry"))
    parts = specs.select(key, "spec").unionByName(items, allowMissingColumns=True).unionByName(observed.select(key).distinct(), allowMissingColumns=True)
    folded = parts.groupBy(key).agg(F.max("spec").alias("spec"), F.map_from_entries(F.collect_list("entry")).alias("paths"))
    start = F.create_map(F.lit("openapi"), F.lit('"3.0.0"'), F.lit("info"), F.lit('{"title": "defacto", "version": "0.0.0"}'))
    given = F.coalesce(_members(F.try_parse_json("spec")), F.create_map().cast("map<string,string>"))
    root = F.map_zip_with(start, given, lambda _, default, own: F.coalesce(own, default))
    return folded.select(key, _object_text(_over(root, {"paths": _object_text(F.col("paths"))})).alias("contract"))


def _members(document: Column, path: str = "$") -> Column:
    """The members of the object at a path of a variant, as JSON texts by name; null where there is no object."""
    return F.transform_values(F.try_variant_get(document, path, "map<string,variant>"), lambda _, v: F.to_json(v))


def _object_text(members: Column) -> Column:
    """The JSON object of members given as JSON texts, sorted by name, without those whose text is null."""
    listed = F.transform(F.array_sort(F.map_entries(members)), lambda m: F.concat(quoted(m["key"]), F.lit(": "), m["value"]))
    return F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}"))


def _over(members: Column, texts: dict[str, Column]) -> Column:
    """members, empty if null, with others in place of or beside them; where a text is null the member stays."""
    known = F.coalesce(members, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(known, F.create_map(*[c for name, text in texts.items() for c in (F.lit(name), text)]), lambda _, old, new: F.coalesce(new, old))


def _laid_over(operations: DataFrame) -> DataFrame:
    """operations(operation, seen, ...) with text: the JSON text of each with its sorted rows of traffic laid over it, or as it is where there are none."""
    document, last = F.col("document"), F.try_element_at("seen", F.lit(-1))
    at = F.try_element_at(F.filter(F.transform("seen", lambda s: s["at"]), lambda t: t.isNotNull()), F.lit(-1))
    rows = operations.withColumn("document", F.try_parse_json("operation"))
    bodies = {"request": "$.requestBody", "response": "$.responses['200']"}
    for role, path in bodies.items():
        usable = F.filter(F.transform("seen", lambda s: s[f"{role}_schema"]), lambda t: F.size(_members(F.try_parse_json(t))) > 0)  # noqa: B023
        rows = rows.withColumn(role, usable)
        kept = F.to_json(F.try_variant_get(document, f"{path}.content['application/json'].schema", "variant"))
        rows = rows.withColumn(role, F.when(F.size(role) > 0, F.array_compact(F.concat(F.array(kept), role))))
        # One schema is itself; only where there are more is there anything to unite.
        rows = rows.withColumn(f"{role}_union", _union(F.when(F.size(role) > 1, F.col(role))))
    body = {}
    for role, path in bodies.items():
        content = f"{path}.content"
        media = _over(_members(document, f"{content}['application/json']"), {"schema": F.coalesce(f"{role}_union", F.get(role, F.lit(0)))})
        own = _members(document, path)
        if role == "response":
            own = F.coalesce(own, F.create_map(F.lit("description"), F.lit('"observed"')))
        whole = _over(own, {"content": _object_text(_over(_members(document, content), {"application/json": _object_text(media)}))})
        body[role] = F.when(F.col(role).isNotNull(), _object_text(whole))
    laid = _over(_members(document), {
        "requestBody": body["request"],
        "responses": F.when(F.col("response").isNotNull(), _object_text(_over(_members(document, "$.responses"), {"200": body["response"]}))),
        "x-sample-count": last["n"].cast("string"),
        "x-matched-static": last["matched"].cast("string"),
        "x-last-seen-at": F.when(at.isNotNull(), quoted(at)),
    })
    return rows.withColumn("text", F.when(F.size("seen") > 0, _object_text(laid)).otherwise(F.col("operation")))


@F.pandas_udf(T.StringType())
def _union(schemas: pd.Series) -> pd.Series:
    """Lists of JSON texts of schemas to that of their union, in order."""
    return pd.Series([None if s is None else json.dumps(reduce(merge_documents, map(_object, s)), sort_keys=True) for s in schemas], dtype=object)
