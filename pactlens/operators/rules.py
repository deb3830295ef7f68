"""Classification of changes by an ordered rule table, and the clients they affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.identity import change_id
from pactlens.functions.lineage import cut, tasks_of
from pactlens.functions.paths import glob_to_regex

#: Rule id, change kind, verdict.
DEFAULT_RULES = (
    ("OAS-PATH-ADDED", "openapi.path.added", "additive"),
    ("OAS-PATH-REMOVED", "openapi.path.removed", "breaking"),
    ("OAS-OP-ADDED", "openapi.operation.added", "additive"),
    ("OAS-OP-REMOVED", "openapi.operation.removed", "breaking"),
    ("OAS-PARAM-ADDED-OPTIONAL", "openapi.parameter.added.optional", "additive"),
    ("OAS-PARAM-ADDED-REQUIRED", "openapi.parameter.added.required", "breaking"),
    ("OAS-PARAM-REMOVED", "openapi.parameter.removed", "behavioral"),
    ("OAS-PARAM-REQUIRED-INCREASED", "openapi.parameter.required.increased", "breaking"),
    ("OAS-PARAM-REQUIRED-DECREASED", "openapi.parameter.required.decreased", "additive"),
    ("OAS-PARAM-TYPE-CHANGED", "openapi.parameter.type_changed", "breaking"),
    ("OAS-BODY-PROP-ADDED-OPTIONAL", "openapi.request_body.property.added.optional", "additive"),
    ("OAS-BODY-PROP-ADDED-REQUIRED", "openapi.request_body.property.added.required", "breaking"),
    ("OAS-BODY-PROP-REMOVED", "openapi.request_body.property.removed", "breaking"),
    ("OAS-BODY-PROP-TYPE-CHANGED", "openapi.request_body.property.type_changed", "breaking"),
    ("OAS-BODY-PROP-REQUIRED-INCREASED", "openapi.request_body.property.required.increased", "breaking"),
    ("OAS-BODY-PROP-REQUIRED-DECREASED", "openapi.request_body.property.required.decreased", "additive"),
    ("OAS-RESPONSE-ADDED", "openapi.response.added", "behavioral"),
    ("OAS-RESPONSE-REMOVED", "openapi.response.removed", "breaking"),
    ("OAS-RESPONSE-PROP-ADDED", "openapi.response.property.added", "additive"),
    ("OAS-RESPONSE-PROP-REMOVED", "openapi.response.property.removed", "breaking"),
    ("OAS-RESPONSE-PROP-TYPE-CHANGED", "openapi.response.property.type_changed", "breaking"),
    ("OAS-ENUM-VALUE-ADDED", "openapi.enum.value.added", "behavioral"),
    ("OAS-ENUM-VALUE-REMOVED", "openapi.enum.value.removed", "breaking"),
    ("PROTO-MESSAGE-ADDED", "proto.message.added", "additive"),
    ("PROTO-MESSAGE-REMOVED", "proto.message.removed", "breaking"),
    ("PROTO-FIELD-ADDED", "proto.field.added", "additive"),
    ("PROTO-FIELD-REMOVED", "proto.field.removed", "breaking"),
    ("PROTO-FIELD-NUMBER-CHANGED", "proto.field.number_changed", "breaking"),
    ("PROTO-FIELD-TYPE-CHANGED", "proto.field.type_changed", "breaking"),
    ("PROTO-FIELD-LABEL-CHANGED", "proto.field.label_changed", "breaking"),
    ("PROTO-FIELD-RENAMED", "proto.field.renamed", "behavioral"),
    ("PROTO-SERVICE-ADDED", "proto.service.added", "additive"),
    ("PROTO-SERVICE-REMOVED", "proto.service.removed", "breaking"),
    ("PROTO-RPC-ADDED", "proto.rpc.added", "additive"),
    ("PROTO-RPC-REMOVED", "proto.rpc.removed", "breaking"),
    ("PROTO-RPC-REQUEST-TYPE-CHANGED", "proto.rpc.request_type_changed", "breaking"),
    ("PROTO-RPC-RESPONSE-TYPE-CHANGED", "proto.rpc.response_type_changed", "breaking"),
)
VERDICTS = ("breaking", "behavioral", "additive")
#: What a change without a rule gets.
FALLBACK_RULE, FALLBACK_VERDICT = "UNCLASSIFIED", "behavioral"
#: A location within an operation: the path, then the verb before one of an operation's parts.
_OPERATION = r"\A/paths/(.+?)/(get|put|post|delete|options|head|patch|trace)(?=/(?:parameters|requestBody|responses)(?:/|\z)|\z)"
_EFFECT = {
    "additive": "existing clients keep working",
    "behavioral": "clients may notice a difference",
    "breaking": "existing clients can fail",
}
#: Call sites per task.
SITES = 500_000
RULES_SHAPE = "ord int, id string, kind string, verdict string, rationale string, location_glob string, location_regex string"


def rule_rows(rules: list[dict]) -> list[tuple]:
    for r in rules:
        if r["verdict"] not in VERDICTS:
            raise ValueError(f"unknown verdict: {r['verdict']}")
    return [
        (n, r["id"], r["kind"], r["verdict"], r.get("rationale") or "", g := r.get("location_glob"), None if g is None else glob_to_regex(g))
        for n, r in enumerate(rules)
    ]


def default_rules() -> list[dict]:
    return [{"id": i, "kind": k, "verdict": v, "rationale": f"{k.split('.', 1)[1].replace('.', ' ').replace('_', ' ')}: {_EFFECT[v]}"} for i, k, v in DEFAULT_RULES]


def load_rules(text: str) -> list[dict]:
    """Rules of a YAML document with a `rules` list; anything else is a ValueError."""
    import yaml

    document = yaml.safe_load(text)
    if not isinstance(document, dict) or not isinstance(document.get("rules", []), list):
        raise ValueError("a ruleset is a mapping with a list of rules")
    return list(document.get("rules", []))


def combine_rules(base: list[dict], own: list[dict], mode: str = "merge") -> list[dict]:
    """merge: own rules take the place of base rules with their id, others follow; replace: own rules only."""
    if mode not in ("merge", "replace"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "replace":
        return list(own)
    mine = {r["id"]: r for r in own}
    known = {r["id"] for r in base}
    return [mine.get(r["id"], r) for r in base] + [r for r in mine.values() if r["id"] not in known]


def rule_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    return spark.createDataFrame(rule_rows(default_rules() if rules is None else rules), RULES_SHAPE)


def classify(changes: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """changes with change_id, rule_id, verdict, rationale: the last rule of the kind whose glob fits.

    keys identify a change row.  The rule table is a page of text and is broadcast.
    """
    fits = (F.col("c.kind") == F.col("r.kind")) & (F.col("r.location_regex").isNull() | F.rlike(F.col("c.location"), F.col("r.location_regex")))
    joined = changes.alias("c").join(F.broadcast(rules.alias("r")), fits, "left")
    last = F.max_by(F.struct("r.id", "r.verdict", "r.rationale"), "r.ord").alias("rule")
    others = [c for c in changes.columns if c not in keys]
    picked = joined.groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(*[F.any_value(F.col(f"c.{c}")).alias(c) for c in others], last)
    return picked.select(
        *changes.columns,
        change_id(F.col("kind"), F.col("location")).alias("change_id"),
        F.coalesce("rule.id", F.lit(FALLBACK_RULE)).alias("rule_id"),
        F.coalesce("rule.verdict", F.lit(FALLBACK_VERDICT)).alias("verdict"),
        F.coalesce("rule.rationale", F.lit("")).alias("rationale"),
    )


def located(changes: DataFrame) -> DataFrame:
    """changes whose path and methods, where null, are read from a location of an operation of a specification."""
    part = lambda n: F.nullif(F.regexp_extract("location", _OPERATION, n), F.lit(""))
    known = F.col("path").isNotNull()
    methods = F.when(part(2).isNotNull(), F.array(F.upper(part(2))))
    return changes.withColumns({"path": F.when(known, F.col("path")).otherwise(part(1)), "methods": F.when(known, F.col("methods")).otherwise(methods)})


def affected_clients(changes: DataFrame, call_sites: DataFrame, keys: list[str], erase_names: bool = False, rpc_keys: bool = False, by_location: bool = False, tasks: int | None = None) -> DataFrame:
    """changes with affected_clients: sorted repositories that call one of the change's methods on its path.

    Templates are compared as text; erase_names makes all placeholders alike.  rpc_keys also matches
    mined RPC calls (method RPC, /service/method) to RPC changes; by_location finds clients of changes
    of properties and enums, whose path and method only their location tells.  Only call sites of changed paths
    leave the join; they are reduced to one per change and repository before they are gathered.  With `tasks`
    the changes meet their clients in so many, or more where the clients found need more, and call sites are
    counted and dealt out to tasks of SITES.
    """
    plain = lambda c: F.regexp_replace(c, r"\{[^}]*\}", "{}") if erase_names else c
    sites = call_sites.select(F.upper("method").alias("k_method"), plain(F.col("path_template")).alias("k_path"), "repo")
    if rpc_keys:
        rpc = F.col("k_method") == "RPC"
        dotted = F.regexp_replace(F.regexp_replace("k_path", r"\A/", ""), "/", ".")
        sites = sites.select(F.when(rpc, "POST").otherwise(F.col("k_method")).alias("k_method"), F.when(rpc, dotted).otherwise(F.col("k_path")).alias("k_path"), "repo")
    asked = located(changes) if by_location else changes
    wanted = asked.select(*keys, plain(F.col("path")).alias("k_path"), F.explode("methods").alias("k_method")).filter("k_path IS NOT NULL")
    where = ["k_method", "k_path"]
    if tasks:  # sorted lists of sites compress too well to go by their shuffled size
        n = max(changes.sparkSession.sparkContext.defaultParallelism, -(-call_sites.count() // SITES))
        wanted, sites = wanted.repartition(n, *where), sites.repartition(n, *where)
    met = wanted.join(sites, where).select(*keys, "repo").distinct()
    if tasks:  # a change can have any number of clients, however short its text
        met = cut(met)
        tasks = max(tasks, tasks_of(met, "repo"))
    dealt = lambda rows: rows.repartition(tasks, *keys) if tasks else rows
    hit = dealt(met).groupBy(*keys).agg(F.array_sort(F.collect_list("repo")).alias("affected_clients"))
    joined = dealt(changes).join(hit, keys, "left")
    return joined.withColumn("affected_clients", F.coalesce("affected_clients", F.array().cast("array<string>")))


def gate(breaking: Column, accepted: Column) -> Column:
    """Whether breaking changes stop a merge."""
    return F.when((breaking > 0) & ~accepted, "failure").otherwise("success")
