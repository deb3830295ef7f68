"""Queries for uploads, linter reports, JSON reports, prompts and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens.functions import identity
from pactlens.operators import guides, reports, rules
from pactlens.plans import contracts, flows
from pactlens.plans.catalogue import call_sites
from pactlens.plans.contracts import diffed
from pactlens.plans.registry import query, table
from pactlens.sources import specs


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'openapi' WHEN page_id % 4 = 3 THEN 'openapi' ELSE 'proto' END AS kind,
  CASE page_id % 4 WHEN 0 THEN '{"page": ' || page_id || '}' END AS spec,
  CASE page_id % 4 WHEN 1 THEN sha256(html) END AS descriptors,
  CASE page_id % 4 WHEN 2 THEN 'not base64' WHEN 3 THEN 'not a JSON object' END AS problem FROM pages WHERE html <> ''""")
def decode_uploads(spark, sf_dir):
    """Uploaded contracts by kind: JSON objects and descriptor sets in base64, and what is neither."""
    turn = F.col("page_id") % 4
    document = (
        F.when(turn == 0, F.concat(F.lit('{"page": '), F.col("page_id").cast("string"), F.lit("}")))
        .when(turn == 1, F.base64(F.col("html").cast("binary")))
        .when(turn == 2, F.lit("*** no base64 ***"))
        .otherwise(F.lit("[1, 2]"))
    )
    uploads = table(spark, sf_dir, "pages").filter("html <> ''").select("page_id", F.when(turn.isin(0, 3), "openapi").otherwise("proto").alias("kind"), document.alias("document"))
    return specs.decode_uploads(uploads).withColumn("descriptors", F.sha2("descriptors", 256))


@query("""SELECT event_id, CAST(0 AS INTEGER) AS position, 'rule-' || event_type AS code, 'field ' || event_id AS message, CAST(event_id % 4 AS BIGINT) AS severity,
  'paths,' || user_id AS path FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 3, 'plain', 'no path', 1, '' FROM events WHERE event_id % 5 <> 0""")
def lint_findings(spark, sf_dir):
    """Findings of one linter report per event; every fifth report is broken, and two items of each are no findings."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("event_id").cast("string").alias("n"))
    first = F.concat(F.lit('[{"code":"rule-'), "event_type", F.lit('","message":"field '), "n", F.lit('","severity":'), (F.col("event_id") % 4).cast("string"), F.lit(',"path":["paths",'), F.col("user_id").cast("string"), F.lit("]}"))
    rest = F.lit(',{"code":7,"message":"m","severity":1},"text",{"code":"plain","message":"no path","severity":1,"path":"x"}]')
    report = F.when(F.col("event_id") % 5 == 0, F.lit("linter not found")).otherwise(F.concat(first, rest))
    return specs.findings(e.select("event_id", report.alias("report")), ("event_id",)).withColumn("path", F.array_join("path", ","))


@query("""SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS campaign, substr('c' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 1, 8) AS short,
  'pactlens/deprecate-c' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS branch FROM customer""")
def campaign_names(spark, sf_dir):
    campaign = F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return table(spark, sf_dir, "customer").select(campaign.alias("campaign"), identity.short_id(campaign).alias("short"), identity.branch_name(campaign).alias("branch"))


_LIST = "'[' || array_to_string(list_transform(repos, lambda x: '\"' || x || '\"'), ',') || ']'"
_ID = "substr(sha1(kind || '::' || location), 1, 16)"
_COUNTS = ",".join(f"\"{v}\":' || count(*) FILTER (verdict = '{v}') || '" for v in ("additive", "behavioral", "breaking"))


@query(f"""SELECT pair, '{{"changes":[' || string_agg('{{"affected_clients":' || {_LIST} || ',"change_id":"' || {_ID} || '","kind":"' || kind || '","location":"' || location || '","rationale":"' || rationale
  || '","rule_id":"' || rule_id || '","verdict":"' || verdict || '"}}', ',' ORDER BY o) || '],"summary":{{{_COUNTS},"total":' || count(*) || '}}}}' AS report FROM {contracts._LINES} GROUP BY pair""")
def report_json(spark, sf_dir):
    return reports.report_json(diffed(spark, sf_dir), ["pair"], "ord")


_CLIENT_HINT = "CASE WHEN len(repos) = 0 THEN '' ELSE ' (affects ' || len(repos) || ' client repo' || CASE WHEN len(repos) = 1 THEN '' ELSE 's' END || ')' END"
_LEVEL = "CASE verdict WHEN 'breaking' THEN 'failure' WHEN 'behavioral' THEN 'warning' ELSE 'notice' END"
_INNER = ", ".join(f"'  \"{c}\": \"' || {v} || '\"'" for c, v in (("change_id", _ID), ("kind", "kind"), ("location", "location"), ("verdict", "verdict"), ("rule_id", "rule_id")))


@query(f"""SELECT * FROM (SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY CASE verdict WHEN 'breaking' THEN 0 WHEN 'behavioral' THEN 1 ELSE 2 END, o) AS INTEGER) AS position,
  'contracts/' || pair || '.json' AS path, CAST(1 AS INTEGER) AS start_line, CAST(1 AS INTEGER) AS end_line, {_LEVEL} AS annotation_level, kind || ' [' || rule_id || ']' AS title,
  location || ': ' || rationale || {_CLIENT_HINT} AS message,
  '{{' || chr(10) || array_to_string([{_INNER}], ',' || chr(10)) || ',' || chr(10) || '  "affected_clients": ' || CASE WHEN len(repos) = 0 THEN '[]' ELSE
    '[' || chr(10) || array_to_string(list_transform(repos, lambda r: '    "' || r || '"'), ',' || chr(10)) || chr(10) || '  ]' END || chr(10) || '}}' AS raw_details
FROM {contracts._LINES}) WHERE position <= 50""")
def check_annotations(spark, sf_dir):
    """What a CI check shows beside each pair's specification."""
    path = F.concat(F.lit("contracts/"), F.col("pair").cast("string"), F.lit(".json"))
    return reports.check_annotations(diffed(spark, sf_dir), ["pair"], "ord", path)


@query(f"""SELECT c.pair, '{{"changes":[' || coalesce(string_agg('{{"affected_clients":' || {_LIST} || ',"change_id":"' || {_ID} || '","kind":"' || kind || '","location":"' || location || '","rationale":"' || rationale
  || '","rule_id":"' || rule_id || '","verdict":"' || verdict || '"}}', ',' ORDER BY o), '') || '],"contract_kind":"openapi","ruleset_id":"shop","spectral_findings":['
  || CASE WHEN c.pair % 3 = 0 THEN '' ELSE '{{"code":"parts","message":"' || any_value(n) || ' parts","path":["paths"],"severity":' || c.pair % 4 || '}}' END || '],"summary":{{{_COUNTS},"total":' || count(l.pair) || '}}}}' AS report
FROM (SELECT p_partkey // {contracts.GROUP} AS pair, count(*) AS n FROM part GROUP BY 1) c LEFT JOIN {contracts._LINES} l ON l.pair = c.pair GROUP BY c.pair""")
def comparison_reports(spark, sf_dir):
    """The report of every pair with what a linter says of it; the linter fails on every third."""
    parts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / contracts.GROUP).cast("bigint").alias("pair")).agg(F.count("*").cast("string").alias("n"))
    said = F.concat(F.lit('[{"code":"parts","message":"'), "n", F.lit(' parts","path":["paths"],"severity":'), (F.col("pair") % 4).cast("string"), F.lit("}]"))
    linted = specs.findings(parts.select("pair", F.when(F.col("pair") % 3 == 0, "linter not found").otherwise(said).alias("report")), ("pair",))
    comparisons = parts.select("pair", F.lit("openapi").alias("contract_kind"))
    return reports.comparison_reports(comparisons, diffed(spark, sf_dir).drop("before", "after"), linted, ["pair"], "ord", "shop")


@query(f"""SELECT pair, kind, location, array_to_string(coalesce(s.repos, []), ',') AS clients FROM {contracts._OPENAPI} c
  LEFT JOIN (SELECT l_partkey AS k, list_sort(list(DISTINCT 'repo-' || l_suppkey)) AS repos FROM lineitem WHERE l_linenumber % 3 = 0 GROUP BY 1) s ON s.k = c.k""")
def clients_by_location(spark, sf_dir):
    """Clients of every change, those of properties and enums found by their location."""
    specifications, sites = contracts.openapi_pairs(spark, sf_dir), call_sites(spark, sf_dir)
    found = flows.diff_contracts("openapi", specifications, rules.rule_table(spark), sites, by_location=True)
    return found.select("pair", "kind", "location", F.array_join("affected_clients", ",").alias("clients"))


@query(f"""WITH d AS (SELECT pair, kind, location, rule_id, rationale, verdict, o, unnest(CASE WHEN len(repos) = 0 THEN [NULL] ELSE repos END) AS repo FROM {contracts._LINES} WHERE verdict <> 'additive'),
 s AS (SELECT 'repo-' || l_suppkey AS client, '- ' || l_orderkey || ':' || l_linenumber || ' calls ' || {contracts._SITE_OF} || ' /part/' || l_partkey AS line,
   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, {contracts._SITE_OF}, '/part/' || l_partkey) AS r FROM lineitem),
 c AS {contracts.GUIDE_REQUESTS},
 lines AS (SELECT c.client, string_agg('- ' || upper(verdict) || ' ' || kind || ' at ' || location || ' (' || rule_id || '): ' || rationale, chr(10) ORDER BY o, kind, location) AS changes
   FROM c JOIN d ON d.pair = c.pair AND (d.repo IS NULL OR d.repo = c.client) GROUP BY 1)
SELECT c.client, sha256('# Migration guide for ' || c.client || chr(10) || 'For each change show the call before and after it in python, each in one fenced block.' || chr(10) || '## Changes' || chr(10)
  || coalesce(l.changes, '- none for this client') || chr(10) || '## Call sites' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY r) FROM s WHERE s.client = c.client AND r <= 10)) AS prompt_hash
FROM c LEFT JOIN lines l ON l.client = c.client""")
def guide_prompts(spark, sf_dir):
    """The hash of what a writer of each client's guide to a comparison is asked for."""
    prompts = guides.render_prompt(contracts.guide_contexts(spark, sf_dir))
    return prompts.select(F.col("client_id").alias("client"), identity.prompt_hash(F.col("prompt")).alias("prompt_hash"))
