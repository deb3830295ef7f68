"""OpenAPI specifications taken apart and compared.

specs(pair, side, spec): side is `before` or `after`, spec is JSON text.  Changes are
pair, kind, location, before, after, path, methods - before and after as JSON text; path and
methods only where a client can be found by them.

The paths of both sides meet in one shuffle by pair and path.  From there on a row holds both sides,
and what is below a path (operations, parameters, responses, properties) is lined up within the row.
Only schemas that refer to a component are joined again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.lineage import TASK_BYTES, cut, tasks_of
from pactlens.operators.routes import VERBS

_MAP, _LIST = "map<string,string>", "array<string>"


def _map(text: Column) -> Column:
    """Members of a JSON object as raw JSON text; anything else has none."""
    return F.coalesce(F.from_json(text, _MAP), F.create_map().cast(_MAP))


def _at(text: Column | str, *path: str) -> Column:
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))


def _meet(specs: DataFrame, tasks: int, *path: str) -> DataFrame:
    """pair, name, b, a: members of an object in the specifications of both sides; null where a side lacks it."""
    rows = specs.select("pair", "side", F.explode(_map(_at("spec", *path))).alias("name", "text")).repartition(tasks, "pair", "name")
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("text"))).alias(side[0])
    return rows.groupBy("pair", "name").agg(one("before"), one("after"))


def _lined_up(rows: DataFrame, keep: list[str], name: str, b: Column, a: Column) -> DataFrame:
    """keep, name, b, a for every key of two maps."""
    both = rows.select(*keep, b.alias("b_all"), a.alias("a_all"))
    each = both.select("*", F.explode(F.array_union(F.map_keys("b_all"), F.map_keys("a_all"))).alias(name))
    return each.select(*keep, name, F.try_element_at("b_all", name).alias("b"), F.try_element_at("a_all", name).alias("a"))


def _verbs(item: Column) -> Column:
    return F.map_filter(_map(item), lambda k, v: F.lower(k).isin(*VERBS))


def _methods(item: Column) -> Column:
    return F.array_sort(F.transform(F.map_keys(_verbs(item)), lambda k: F.upper(k)))


def _literals(enum: Column) -> Column:
    """Values of a JSON list as Python would print them; null if it is no list."""

    def one(v: Column) -> Column:
        text = v.cast("string")
        quoted = F.when(text.contains("'") & ~text.contains('"'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
        )
        kind = F.schema_of_variant(v)
        named = F.when(text == "true", F.lit("True")).when(text == "false", F.lit("False"))
        return F.when(kind == "STRING", quoted).when(kind == "BOOLEAN", named).when(kind == "VOID", F.lit("None")).otherwise(text)

    return F.array_distinct(F.transform(F.from_json(enum, "array<variant>"), one))


def _case(test: Column, kind: Column | str, before: Column, after: Column) -> Column:
    """A change if the test holds, else null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    change = F.struct(kind.alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after"))
    return F.when(test, change)


def _emit(rows: DataFrame, location: Column, cases: list[Column], path: Column | None = None, methods: Column | None = None) -> DataFrame:
    """One row per case that holds."""
    path, methods = (F.lit(None) if c is None else c for c in (path, methods))
    found = rows.select("pair", location.alias("location"), path.cast("string").alias("path"), methods.cast(_LIST).alias("methods"), F.explode(F.array_compact(F.array(*cases))).alias("c"))
    return found.select("pair", "c.kind", "location", "c.before", "c.after", "path", "methods")


def _parameters(op: Column) -> Column:
    """Parameters of an operation as (place and name, text); `in` defaults to query, what is no named object is left out."""
    listed = F.coalesce(F.from_json(_at(op, "parameters"), _LIST), F.array().cast(_LIST))
    named = F.filter(listed, lambda p: F.json_object_keys(p).isNotNull() & _at(p, "name").isNotNull())
    return F.transform(named, lambda p: F.struct(F.concat(F.coalesce(_at(p, "in"), F.lit("query")), F.lit("/"), _at(p, "name")).alias("key"), p.alias("text")))


def _parameter_changes(ops: DataFrame, place: Column, verb: Column) -> DataFrame:
    both = ops.select("pair", "path", "method", _parameters(F.col("b")).alias("b_all"), _parameters(F.col("a")).alias("a_all"))
    keys = lambda c: F.transform(c, lambda p: p["key"])
    each = both.select("*", F.explode(F.array_union(keys("b_all"), keys("a_all"))).alias("key"))
    last = lambda c: F.try_element_at(F.filter(c, lambda p: p["key"] == F.col("key")), F.lit(-1))["text"]
    rows = each.select("pair", "path", "method", "key", last("b_all").alias("b"), last("a_all").alias("a"))
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    must = lambda c: F.coalesce(_at(c, "required"), F.lit("false")) == "true"
    kind = lambda c: F.coalesce(_at(c, "schema", "type"), _at(c, "type"))
    stem = "openapi.parameter."
    cases = [
        _case(new, F.when(must("a"), stem + "added.required").otherwise(stem + "added.optional"), F.col("b"), F.col("a")),
        _case(gone, stem + "removed", F.col("b"), F.col("a")),
        _case(~new & ~gone & must("a") & ~must("b"), stem + "required.increased", must("b"), must("a")),
        _case(~new & ~gone & must("b") & ~must("a"), stem + "required.decreased", must("b"), must("a")),
        _case(~new & ~gone & ~kind("a").eqNullSafe(kind("b")), stem + "type_changed", kind("b"), kind("a")),
    ]
    return _emit(rows, F.concat(place, F.lit("/parameters/"), F.col("key")), cases, F.col("path"), verb)


def _refers(side: str) -> Column:
    return _at(side, "$ref").isNotNull()


def _resolved(rows: DataFrame, components: DataFrame, side: str, tasks: int) -> DataFrame:
    """rows with the schema of a side replaced by the component that it names, one hop; a missing one is empty."""
    name = F.regexp_extract(F.coalesce(_at(side, "$ref"), F.lit("")), r"\A#/components/schemas/(.+)\z", 1)
    parts = components.select("pair", F.col("name").alias("c_name"), F.col(side).alias("c_schema")).filter("c_schema IS NOT NULL")
    joined = rows.withColumn("c_name", F.nullif(name, F.lit(""))).repartition(tasks, "pair", "c_name").join(parts, ["pair", "c_name"], "left")
    schema = F.when(_refers(side), F.coalesce("c_schema", F.lit("{}"))).otherwise(F.col(side))
    return joined.withColumn(side, schema).drop("c_name", "c_schema")


def _property_changes(schemas: DataFrame, place: Column) -> DataFrame:
    """Changes of the properties (one level) of schemas that both sides have."""
    keep = ["pair", "path", "method", "place", "role"]
    required = lambda c: F.coalesce(F.from_json(_at(c, "required"), _LIST), F.array().cast(_LIST))
    rows = schemas.select(*keep, required("b").alias("b_must"), required("a").alias("a_must"), "b", "a")
    rows = _lined_up(rows, [*keep, "b_must", "a_must"], "name", _map(_at("b", "properties")), _map(_at("a", "properties")))
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    kept, body = ~new & ~gone, F.col("role") == "request_body"
    b_must, a_must = F.array_contains("b_must", F.col("name")), F.array_contains("a_must", F.col("name"))
    b_type, a_type = _at("b", "type"), _at("a", "type")
    stem = F.concat(F.lit("openapi."), F.col("role"), F.lit(".property."))
    added = F.concat(stem, F.when(~body, "added").when(a_must, "added.required").otherwise("added.optional"))
    at = F.concat(place, F.lit("/"), F.col("place"), F.lit("/properties/"), F.col("name"))
    cases = [
        _case(new, added, F.col("b"), F.col("a")),
        _case(gone, F.concat(stem, F.lit("removed")), F.col("b"), F.col("a")),
        _case(kept & ~a_type.eqNullSafe(b_type), F.concat(stem, F.lit("type_changed")), b_type, a_type),
        _case(kept & body & a_must & ~b_must, F.concat(stem, F.lit("required.increased")), b_must, a_must),
        _case(kept & body & b_must & ~a_must, F.concat(stem, F.lit("required.decreased")), b_must, a_must),
    ]
    return _emit(rows, at, cases).unionByName(_enum_changes(rows, F.concat(at, F.lit("/enum"))))


def _enum_changes(rows: DataFrame, location: Column) -> DataFrame:
    """Added and removed values of enums that both sides declare."""
    enums = rows.filter("a IS NOT NULL AND b IS NOT NULL").select("pair", location.alias("at"), _literals(_at("b", "enum")).alias("b"), _literals(_at("a", "enum")).alias("a"))
    none = F.lit(None).cast("string")
    change = lambda kind, before, after: F.struct(F.lit(f"openapi.enum.value.{kind}").alias("kind"), before.alias("before"), after.alias("after"))
    more = F.transform(F.array_except("a", "b"), lambda v: change("added", none, v))
    less = F.transform(F.array_except("b", "a"), lambda v: change("removed", v, none))
    each = enums.select("pair", "at", F.explode(F.concat(more, less)).alias("c"))
    return each.select("pair", "c.kind", F.col("at").alias("location"), "c.before", "c.after", none.alias("path"), F.lit(None).cast(_LIST).alias("methods"))


def diff_openapi(specs: DataFrame) -> DataFrame:
    """All changes between the two sides of every pair; a side without a row is an empty specification.

    Null or unreadable specifications are empty ones; of repeated rows of a side one counts.
    """
    new, gone = F.col("b").isNull(), F.col("a").isNull()
    both = "a IS NOT NULL AND b IS NOT NULL"

    specs = cut(specs.select("pair", "side", "spec"))  # measured, and read for the paths and for the components
    tasks = tasks_of(specs, "spec", limit=TASK_BYTES)
    items = cut(_meet(specs, tasks, "paths")).withColumnRenamed("name", "path")  # read by every kind of change
    cases = [_case(new, "openapi.path.added", F.col("b"), F.col("a")), _case(gone, "openapi.path.removed", F.col("b"), F.col("a"))]
    out = [_emit(items, F.concat(F.lit("/paths/"), F.col("path")), cases, F.col("path"), _methods(F.coalesce("a", "b")))]

    place = F.concat(F.lit("/paths/"), F.col("path"), F.lit("/"), F.col("method"))
    verb = F.array(F.upper("method"))
    ops = _lined_up(items.filter(both), ["pair", "path"], "method", _verbs(F.col("b")), _verbs(F.col("a")))
    cases = [_case(new, "openapi.operation.added", F.col("b"), F.col("a")), _case(gone, "openapi.operation.removed", F.col("b"), F.col("a"))]
    out.append(_emit(ops, place, cases, F.col("path"), verb))

    ops = ops.filter(both)
    out.append(_parameter_changes(ops, place, verb))
    must = lambda c: F.coalesce(_at(c, "requestBody", "required"), F.lit("false")) == "true"
    stem = "openapi.request_body.property.required."
    cases = [_case(must("a") & ~must("b"), stem + "increased", must("b"), must("a")), _case(must("b") & ~must("a"), stem + "decreased", must("b"), must("a"))]
    out.append(_emit(ops, F.concat(place, F.lit("/requestBody")), cases, F.col("path"), verb))

    answers = _lined_up(ops, ["pair", "path", "method"], "status", _map(_at("b", "responses")), _map(_at("a", "responses")))
    cases = [_case(new, "openapi.response.added", F.col("b"), F.col("a")), _case(gone, "openapi.response.removed", F.col("b"), F.col("a"))]
    out.append(_emit(answers, F.concat(place, F.lit("/responses/"), F.col("status")), cases, F.col("path"), verb))

    # Schemas are compared where both sides have the operation or the response.
    json = ("content", "application/json", "schema")
    of = lambda place, role, *path: [F.lit(role).alias("role"), place.alias("place"), *[F.coalesce(_at(c, *path, *json), F.lit("{}")).alias(c) for c in ("b", "a")]]
    keys = ["pair", "path", "method"]
    schemas = ops.select(*keys, *of(F.lit("requestBody"), "request_body", "requestBody"))
    schemas = schemas.unionByName(answers.filter(both).select(*keys, *of(F.concat(F.lit("responses/"), F.col("status")), "response")))
    components = cut(_meet(specs, tasks, "components", "schemas"))
    refers = _refers("b") | _refers("a")
    referring = schemas.filter(refers)
    for side in ("b", "a"):
        referring = _resolved(referring, components, side, tasks)
    out.append(_property_changes(schemas.filter(~refers).unionByName(referring), place))
    out.append(_enum_changes(components, F.concat(F.lit("/components/schemas/"), F.col("name"), F.lit("/enum"))))
    return reduce(DataFrame.unionByName, out)
