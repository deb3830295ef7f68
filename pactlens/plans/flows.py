"""Whole flows: what registering a version, ingesting traffic, comparing contracts, mining a tree or evaluating campaigns does.

Clocks and earlier tables are arguments; results are DataFrames that the caller writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions.identity import canonical_json, version_hash
from pactlens.functions.lineage import cut, tasks_of
from pactlens.functions.names import unused
from pactlens.operators import campaigns as campaign_ops
from pactlens.operators import ingest, mining, openapi_diff, proto_diff, routes, rules, store
from pactlens.sources.code import read_tree

KINDS = ("openapi", "proto")


def register_versions(versions: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads(service, name, kind, spec) with version_hash, outcome.

    OpenAPI specifications are hashed as canonical JSON, descriptor sets (base64) as their bytes.
    outcome is `invalid` (no such content), `known` (the service has this content), `kind differs` (the
    contract of that name has another kind) or `created`.  versions(service, name, kind, version_hash)
    are the earlier ones.  Uploads count in order of their column `ord`, if they have one, then by name
    and kind: a new contract has the kind of its first upload, refused uploads create nothing, and of
    equal ones that are not refused the first is created and the others are known.
    """
    read = F.when(F.col("kind") == "openapi", version_hash(canonical_json("spec"))).when(F.col("kind") == "proto", F.sha2(F.expr("try_to_binary(spec, 'base64')"), 256))
    kind, seen, first = (unused(uploads, n) for n in ("contract_kind", "stored", "first_kind"))
    order = [F.col(c) for c in (["ord"] if "ord" in uploads.columns else []) + ["name", "kind"]]
    kinds = versions.groupBy("service", "name").agg(F.any_value("kind").alias(kind))
    stored = versions.select("service", "version_hash").distinct().withColumn(seen, F.lit(True))
    joined = uploads.withColumn("version_hash", read).join(stored, ["service", "version_hash"], "left").join(kinds, ["service", "name"], "left")
    fresh = F.col("version_hash").isNotNull() & F.col(seen).isNull()
    # A minimum per name combines before the shuffle.
    new = joined.filter(fresh & F.col(kind).isNull()).groupBy("service", "name").agg(F.min_by("kind", F.struct(*order)).alias(first))
    judged = joined.join(new, ["service", "name"], "left")
    refused = fresh & (F.coalesce(kind, first) != F.col("kind"))
    place = F.row_number().over(Window.partitionBy("service", "version_hash", refused).orderBy(*order))
    outcome = F.when(F.col("version_hash").isNull(), "invalid").when(F.col(seen).isNotNull(), "known").when(refused, "kind differs").when(place == 1, "created").otherwise("known")
    return judged.withColumn("outcome", outcome).select(*uploads.columns, "version_hash", "outcome")


def ingest_traffic(calls: DataFrame, spec_routes: DataFrame, observed: DataFrame, usage: DataFrame, batches: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observed endpoints, field usage, summary) after a batch of calls.

    calls(batch_hash, client_id, method, url, request_body, response_body, ts); observed(method,
    path_template, sample_count, last_seen_at, matched, request_schema, response_schema); usage(method,
    path_template, client_id, role, path, count, json_types, last_seen_at).  Batches that are known
    add nothing; with strict=False their samples are counted once more, as in the original, and only
    counts of fields stay.  Counts of endpoints add up and their schemas merge; a field that is known keeps its
    count and is seen anew.
    """
    roles = {"request": "request_body", "response": "response_body"}
    endpoint = ("method", "path_template")
    new = calls.join(batches.select("batch_hash").distinct(), "batch_hash", "left_anti") if strict else calls
    matched = routes.match_routes(new, spec_routes)
    fresh = ingest.observed_endpoints(matched, endpoint)
    schemas = ingest.infer_schemas(matched, endpoint, roles).groupBy(*endpoint).pivot("role", list(roles)).agg(F.first("schema"))
    fresh = fresh.join(schemas.withColumnsRenamed({r: f"{r}_schema" for r in roles}), list(endpoint), "left")
    union = lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None).cast("string")).otherwise(ingest.merge_schemas(a, b))
    resolve = {
        "sample_count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "last_seen_at": F.greatest,
        "matched": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
        "request_schema": union,
        "response_schema": union,
    }
    endpoints = store.merge_by_key(observed, fresh.select(*observed.columns), list(endpoint), resolve)
    key = (*endpoint, "client_id")
    found = ingest.field_usage(ingest.field_nodes(matched, key, roles), key)
    keep = {"count": lambda a, b: F.coalesce(a, b), "json_types": lambda a, b: F.coalesce(a, b), "last_seen_at": lambda a, b: F.coalesce(b, a)}
    fields = store.merge_by_key(usage, found.select(*usage.columns), [*key, "role", "path"], keep)
    return endpoints, fields, ingest.ingest_summary(fresh)


def ordered(changes: DataFrame) -> DataFrame:
    """changes with ord: within a pair paths before components, added before removed before changed, then by location and kind."""
    rank = F.when(F.col("location").startswith("/components/"), 3).when(F.col("kind").endswith("path.added"), 0).when(F.col("kind").endswith("path.removed"), 1).otherwise(2)
    order = Window.partitionBy("pair").orderBy(rank, "location", "kind", F.col("before").asc_nulls_first(), F.col("after").asc_nulls_first())
    return changes.withColumn("ord", F.row_number().over(order))


def diff_contracts(kind: str, specs: DataFrame, table_of_rules: DataFrame, call_sites: DataFrame, **options) -> DataFrame:
    """Classified changes of every pair of specifications with the clients that each affects.

    specs as openapi_diff or proto_diff take them, call_sites(repo, method, path_template); options are
    those of rules.affected_clients.  Changes are numbered within a pair by `ord`.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    changes = cut(openapi_diff.diff_openapi(specs) if kind == "openapi" else proto_diff.diff_proto(specs))  # measured, then dealt out
    tasks = tasks_of(changes, "kind", "location", "before", "after")
    # Reports read a comparison many times; it is a small table that took long to make.
    classified = cut(rules.classify(ordered(changes.repartition(tasks, "pair")), table_of_rules, ["pair", "ord"]))
    return cut(rules.affected_clients(classified, call_sites, ["pair", "ord"], tasks=tasks, **options))


def mine_repo(spark: SparkSession, root: str, repo: str, commit_sha: str, known: DataFrame) -> DataFrame:
    """Call sites of a source tree whose content hash the repository's commit does not have yet."""
    files = read_tree(spark, root).select(F.lit(repo).alias("repo"), F.lit(commit_sha).alias("commit_sha"), "file", "language", "content")
    return store.insert_absent(known, mining.mine_call_sites(files), ["repo", "commit_sha", "content_hash"])


def evaluate_campaigns(campaigns: DataFrame, usages: DataFrame, metrics: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(campaigns in their next state, a new metric row per open one); metrics(campaign_id, sampled_at, usage_count, ewma_value, remaining_client_count)."""
    last = store.latest_per_group(metrics, ["campaign_id"], [F.desc("sampled_at")]).select(F.col("campaign_id").alias("id"), "ewma_value")
    found = campaign_ops.evaluate(campaigns, usages, last, as_of)
    moved = campaigns.drop("state").join(found.select("id", F.col("next_state").alias("state")), "id")
    samples = found.filter("usage_count IS NOT NULL").select(F.col("id").alias("campaign_id"), as_of.alias("sampled_at"), "usage_count", "ewma_value", F.col("client_count").alias("remaining_client_count"))
    return moved, samples


def validated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with `problems`: the sorted names of the checks that do not hold (a check that is null does not)."""
    failed = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, test in sorted(checks.items())])
    return rows.withColumn("problems", F.array_compact(failed.cast("array<string>")))


def run_checks() -> dict[str, Column]:
    """What the columns repo, head_sha, pull_request, usage_threshold_pct and decay_window_days must hold."""
    return {
        "repo": F.col("repo").rlike(r"\A[^/\s]+/[^/\s]+\z"),
        "head_sha": F.col("head_sha").rlike(r"\A[0-9a-fA-F]{7,64}\z"),
        "pull_request": F.col("pull_request") >= 1,
        "usage_threshold_pct": F.col("usage_threshold_pct").between(0, 100),
        "decay_window_days": F.col("decay_window_days").between(1, 365),
    }
