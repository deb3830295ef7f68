"""The library's queries over the test tables, and DuckDB SQL for the same rows.

events are calls (client user_id, endpoint event_type, body props), lineitem x part x supplier a
catalogue of call sites (supplier: repository, part: endpoint), orders versioned rows per customer,
documents and pages contents with identities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions import decay, identity, lineage, paths
from pactlens.operators import campaigns, guides, ingest, reports, routes, rules, store, tables
from pactlens.plans.registry import ORACLES, query, table

AS_OF = "2024-01-31 00:00:00"
ROUTES = (
    ("GET", "/item/{id}"),
    ("GET", "/item/{id}/reviews"),
    ("GET", "/news/{slug}"),
    ("GET", "/blog/{year}/{slug}"),
    ("GET", "/tag/{name}"),
    ("GET", "/{section}"),
    ("GET", "/{section}/{page}"),
)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("POST").alias("method"), F.concat(F.lit("/"), "event_type").alias("path_template"), F.col("event_type").alias("endpoint_id"),
        F.col("user_id").cast("string").alias("client_id"), F.col("props").alias("request_body"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "view").alias("matched"),
    )


_TS = "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"
_show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"""SELECT 'POST' AS method, '/' || event_type AS path_template, CAST(count(*) AS BIGINT) AS sample_count,
       {_TS} AS last_seen_at, bool_or(event_type <> 'view') AS matched FROM events GROUP BY event_type""")
def observed_endpoints(spark, sf_dir):
    return ingest.observed_endpoints(calls(spark, sf_dir)).withColumn("last_seen_at", _show(F.col("last_seen_at")))


@query("""SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS observed_endpoints,
       CAST(count(DISTINCT CASE WHEN event_type <> 'view' THEN event_type END) AS BIGINT) AS matched_endpoints,
       CAST(count(*) AS BIGINT) AS records FROM events""")
def ingest_summary(spark, sf_dir):
    return ingest.ingest_summary(ingest.observed_endpoints(calls(spark, sf_dir)))


@query(f"""WITH n AS (
  SELECT event_type AS endpoint_id, ts, '$' AS path, 'object' AS type FROM events WHERE props IS NOT NULL
  UNION ALL SELECT event_type, ts, '$.k', 'integer' FROM events WHERE props IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL)
SELECT endpoint_id, path, type, CAST(count(*) AS BIGINT) AS n, {_TS} AS last_seen_at FROM n GROUP BY ALL""")
def field_usage(spark, sf_dir):
    nodes = ingest.field_nodes(calls(spark, sf_dir), ("endpoint_id",), {"request": "request_body"})
    usage = ingest.field_usage(nodes, ("endpoint_id",))
    flat = usage.select("endpoint_id", "path", F.explode("json_types").alias("type", "n"), "last_seen_at")
    return flat.withColumn("last_seen_at", _show(F.col("last_seen_at")))


@query("""WITH v AS (SELECT 'events.event_type' AS field, event_type AS value FROM events
  UNION ALL SELECT 'orders.o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT 'lineitem.l_returnflag', l_returnflag FROM lineitem
  UNION ALL SELECT 'orders.o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT 'part.p_type', p_type FROM part UNION ALL SELECT 'customer.c_name', c_name FROM customer)
SELECT field, string_agg(DISTINCT value, ',' ORDER BY value) AS enum FROM v WHERE value IS NOT NULL
GROUP BY field HAVING count(DISTINCT value) BETWEEN 2 AND 8 AND count(*) >= 2 * count(DISTINCT value)""")
def enum_detection(spark, sf_dir):
    fields = {"events": ["event_type"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag"], "part": ["p_type"], "customer": ["c_name"]}
    nodes = None
    for name, columns in fields.items():
        for c in columns:
            one = table(spark, sf_dir, name).select(F.lit(f"{name}.{c}").alias("field"), F.lit("row").alias("role"), F.lit("$").alias("path"), F.lit("string").alias("type"), F.col(c).alias("text"))
            nodes = one if nodes is None else nodes.unionByName(one)
    found = ingest.enum_values(nodes.filter("text IS NOT NULL"), ("field",))
    return found.select("field", F.array_join("enum", ",").alias("enum"))


_PATH = r"""CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) ELSE split_part(url, '?', 1) END"""
_SLASH = f"CASE WHEN starts_with({_PATH}, '/') THEN {_PATH} ELSE '/' || {_PATH} END"
_ABSTRACT = r"""array_to_string(list_transform(string_split({}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN '{{id}}' ELSE s END), '/')"""


@query(f"SELECT page_id, {_SLASH} AS path, {_ABSTRACT.format(_SLASH)} AS template FROM pages")
def url_normalize(spark, sf_dir):
    path = paths.strip_to_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), paths.abstract_static_segments(path).alias("template"))


_SEGMENTS = f"list_filter(string_split({_SLASH}, '/'), lambda s: s <> '')"


@query(f"""SELECT page_id, CASE WHEN len(s) = 0 THEN path WHEN s[1] = 'item' AND len(s) = 2 THEN '/item/{{id}}' WHEN s[1] = 'item' AND len(s) = 3 AND s[3] = 'reviews' THEN '/item/{{id}}/reviews'
    WHEN s[1] = 'news' AND len(s) = 2 THEN '/news/{{slug}}' WHEN s[1] = 'blog' AND len(s) = 3 THEN '/blog/{{year}}/{{slug}}' WHEN s[1] = 'tag' AND len(s) = 2 THEN '/tag/{{name}}'
    WHEN s[1] NOT IN ('item', 'news', 'blog', 'tag') AND len(s) = 1 THEN '/{{section}}' WHEN s[1] NOT IN ('item', 'news', 'blog', 'tag') AND len(s) = 2 THEN '/{{section}}/{{page}}'
    ELSE template END AS path_template,
  coalesce(s[1] = 'item' AND (len(s) = 2 OR len(s) = 3 AND s[3] = 'reviews') OR s[1] IN ('news', 'tag') AND len(s) = 2 OR s[1] = 'blog' AND len(s) = 3
    OR s[1] NOT IN ('item', 'news', 'blog', 'tag') AND len(s) IN (1, 2), false) AS matched
FROM (SELECT page_id, {_SLASH} AS path, {_SEGMENTS} AS s, {_ABSTRACT.format(_SLASH)} AS template FROM pages)""")
def route_match(spark, sf_dir):
    table_of_routes = spark.createDataFrame([(m, t, n) for n, (m, t) in enumerate(ROUTES)], "method string, path_template string, ord int")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("GET").alias("method"))
    return routes.match_routes(pages, table_of_routes).select("page_id", "path_template", "matched")


@query(f"""SELECT page_id, page_id % 3 AS service, CASE WHEN page_id % 3 = 2 THEN u.template ELSE r.path_template END AS path_template, r.matched AND page_id % 3 <> 2 AS matched
FROM ({ORACLES['route_match']}) r JOIN ({ORACLES['url_normalize']}) u USING (page_id)""")
def route_match_services(spark, sf_dir):
    """Pages of three services, two of which have the routes as their own."""
    own = [(s, m, t, n) for s in (0, 1) for n, (m, t) in enumerate(ROUTES)]
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("service"), "url", F.lit("GET").alias("method"))
    found = routes.match_routes(pages, spark.createDataFrame(own, "service bigint, method string, path_template string, ord int"), keys=("service",))
    return found.select("page_id", "service", "path_template", "matched")


@query("""SELECT sha256(text) AS version_hash, min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS copies
FROM documents GROUP BY 1""")
def version_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", identity.version_hash(F.col("text")).alias("version_hash"))
    return docs.groupBy("version_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("""SELECT doc_id, sha256(CASE WHEN text <> '' THEN 'HAR' || chr(10) || text ELSE '' END
  || CASE WHEN source <> '' THEN chr(10) || 'GRPC' || chr(10) || source ELSE '' END) AS batch_hash FROM documents""")
def batch_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", identity.batch_hash(F.col("text"), F.col("source")).alias("batch_hash"))


_SITES = """(SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'repo-' || CAST(l_suppkey AS VARCHAR) AS repo,
  CASE l_linenumber % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'DELETE' END AS method,
  '/part/' || CAST(l_partkey AS VARCHAR) AS path_template FROM lineitem)"""


def call_sites(spark, sf_dir):
    m = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("repo-"), F.col("l_suppkey").cast("string")).alias("repo"),
        F.when(m == 0, "GET").when(m == 1, "POST").otherwise("DELETE").alias("method"),
        F.concat(F.lit("/part/"), F.col("l_partkey").cast("string")).alias("path_template"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', repo, CAST(l_linenumber AS VARCHAR), 'python', 'requests', method, path_template, 'a,b')) AS content_hash
FROM {_SITES}""")
def call_site_hash(spark, sf_dir):
    s = call_sites(spark, sf_dir)
    fields = F.array(F.lit("b"), F.lit("a"))
    h = identity.call_site_hash(F.col("repo"), F.col("l_linenumber"), F.lit("python"), F.lit("requests"), F.col("method"), F.col("path_template"), fields)
    return s.select("l_orderkey", "l_linenumber", h.alias("content_hash"))


@query("""SELECT event_type AS endpoint_id, CAST(user_id AS VARCHAR) AS client_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, CAST(count(*) AS BIGINT) AS request_count
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3, 4""")
def usage_windows(spark, sf_dir):
    w = campaigns.usage_windows(calls(spark, sf_dir))
    return w.withColumn("window_start", _show(F.col("window_start"))).withColumn("window_end", _show(F.col("window_end")))


def _campaigns(spark, sf_dir):
    ends = table(spark, sf_dir, "events").select("event_type").distinct()
    return ends.select(
        F.concat(F.lit("c-"), "event_type").alias("id"), F.col("event_type").alias("endpoint_id"),
        F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "decaying").otherwise("draft").alias("state"),
        F.lit(5.0).alias("usage_threshold_pct"), (F.length("event_type") + 3).alias("decay_window_days"), F.lit(100000).cast("bigint").alias("peak_usage"),
    )


_CAMPAIGNS = """(SELECT DISTINCT 'c-' || event_type AS id, event_type AS endpoint_id,
  CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'decaying' ELSE 'draft' END AS state,
  length(event_type) + 3 AS days FROM events)"""
_ROLLING = f"""(SELECT c.id, c.state, CAST(count(e.event_id) AS BIGINT) AS usage_count, CAST(count(DISTINCT e.user_id) AS BIGINT) AS client_count
  FROM {_CAMPAIGNS} c LEFT JOIN events e ON e.event_type = c.endpoint_id
   AND date_trunc('day', e.ts) + INTERVAL 1 DAY >= TIMESTAMP '{AS_OF}' - to_days(CAST(c.days AS INTEGER)) GROUP BY 1, 2)"""


@query(f"SELECT id, usage_count, client_count FROM {_ROLLING}")
def rolling_usage(spark, sf_dir):
    return campaigns.rolling_usage(_campaigns(spark, sf_dir), campaigns.usage_windows(calls(spark, sf_dir)), F.lit(AS_OF).cast("timestamp"))


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2),
 s AS (SELECT event_type, list(CAST(n AS DOUBLE) ORDER BY day) AS xs FROM d GROUP BY 1)
SELECT event_type, round(list_reduce(list_prepend(round(xs[1], 4), xs[2:]), lambda e, x: round(2.0 / 31 * x + (1.0 - 2.0 / 31) * e, 4)), 3) AS ewma_value FROM s""")
def ewma_decay(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    out = campaigns.smoothed(daily, ["event_type"], "day", "n", F.lit(30))
    return out.withColumn("ewma_value", F.round("ewma_value", 3))


@query("""SELECT event_type AS campaign_id, CAST(date_trunc('day', ts) AS DATE) AS date, CAST(count(*) AS BIGINT) AS usage_count, floor(count(*) / 7.0::DOUBLE * 100 + 0.5) / 100 AS ewma_value,
  CAST(count(DISTINCT user_id) AS BIGINT) AS remaining_clients FROM events GROUP BY 1, 2""")
def decay_chart(spark, sf_dir):
    day = calls(spark, sf_dir).groupBy(F.col("endpoint_id").alias("campaign_id"), F.date_trunc("day", "ts").alias("sampled_at"))
    metrics = day.agg(F.count("*").alias("usage_count"), F.countDistinct("client_id").alias("remaining_client_count")).withColumn("ewma_value", F.col("usage_count") / F.lit(7.0))
    return campaigns.decay_chart(metrics)


@query("""SELECT o_orderkey, substr(sha256('=' || o_custkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '=' || o_orderstatus END), 1, 32) AS id FROM orders""")
def surrogate_ids(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.surrogate_id(F.col("o_custkey"), status).alias("id"))


@query(f"""SELECT id, state, usage_count, client_count,
  CASE WHEN state = 'active' AND CAST(usage_count AS DOUBLE) / 100000 * 100.0 <= 4.99 THEN 'decaying'
       WHEN state = 'decaying' AND CAST(usage_count AS DOUBLE) / 100000 * 100.0 <= 0.99 THEN 'ready_to_remove' ELSE state END AS next_state FROM {_ROLLING}""")
def fsm_step(spark, sf_dir):
    last = spark.createDataFrame([], "id string, ewma_value double")
    out = campaigns.evaluate(_campaigns(spark, sf_dir), campaigns.usage_windows(calls(spark, sf_dir)), last, F.lit(AS_OF).cast("timestamp"))
    return out.drop("ewma_value")


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2),
 s AS (SELECT user_id, list(n ORDER BY day) AS xs, CAST(max(n) AS DOUBLE) AS peak FROM d GROUP BY 1)
SELECT user_id, list_reduce(list_prepend('active', list_transform(xs, lambda x: CASE WHEN x / peak * 100.0 <= 0.99 THEN 'r' WHEN x / peak * 100.0 <= 59.99 THEN 'd' ELSE '-' END)),
  lambda st, x: CASE WHEN st = 'active' AND x IN ('d', 'r') THEN 'decaying' WHEN st = 'decaying' AND x = 'r' THEN 'ready_to_remove' ELSE st END) AS state FROM s""")
def fsm_replay(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    per = daily.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("s"), F.max("n").alias("peak"))
    xs = F.transform("s", lambda x: x["n"])
    return per.select("user_id", decay.replay_states(F.lit("active"), xs, F.col("peak"), F.lit(60.0)).alias("state"))


@query("""SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    # A maximum per key combines before the shuffle; a window would not.
    top = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return top.select("o_custkey", "m.o_orderkey", F.date_format("m.o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query("""WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS seen FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1),
 b AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS seen FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(a.n, b.n) AS n, coalesce(b.seen, a.seen) AS seen FROM a FULL OUTER JOIN b ON a.k = b.k""")
def upsert_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    split = F.lit("1995-01-01").cast("timestamp_ntz")
    side = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("seen"))
    old, new = side(o.filter(F.col("o_orderdate") < split)), side(o.filter(F.col("o_orderdate") >= split))
    return store.merge_by_key(old, new, ["o_custkey"], {"n": lambda a, b: F.coalesce(a, b), "seen": lambda a, b: F.coalesce(b, a)})


@query(ORACLES["upsert_merge"])
def stored_upserts(spark, sf_dir):
    """The same merge as writes of a table in buckets: one side inserted, the other upserted by customer, one batch of it sent twice."""
    o = table(spark, sf_dir, "orders")
    split = F.lit("1995-01-01").cast("timestamp_ntz")
    side = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("seen"))
    new = side(o.filter(F.col("o_orderdate") >= split))
    stored = tables.KeyedTable(spark, lineage.scratch(spark, "customers"), "o_custkey bigint, n bigint, seen string", ["o_custkey"], buckets=16)
    stored.insert(side(o.filter(F.col("o_orderdate") < split)), ("load", 0))
    rules_of = {"n": lambda a, b: F.coalesce(a, b), "seen": lambda a, b: F.coalesce(b, a)}
    for number, part in ((0, new.filter("o_custkey % 2 = 0")), (1, new.filter("o_custkey % 2 = 1")), (1, new.filter("o_custkey % 2 = 1"))):
        stored.upsert(part, rules_of, ("later", number))
    return stored.read()


@query("""WITH i AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 2 = 1), e AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0)
SELECT CAST((SELECT count(*) FROM i) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS inserted, CAST((SELECT count(*) FROM i) - count(*) AS BIGINT) AS skipped
FROM (SELECT DISTINCT h FROM i WHERE h NOT IN (SELECT h FROM e WHERE h IS NOT NULL))""")
def insert_anti(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", identity.version_hash(F.col("text")).alias("h"))
    return store.insert_counts(d.filter("doc_id % 2 = 0").select("h"), d.filter("doc_id % 2 = 1").select("h"), ["h"])


_SETS = """(SELECT p_partkey AS k, p_brand, p_size,
   p_partkey % 10 <> 0 AS in_before, p_partkey % 10 <> 1 AS in_after, p_partkey % 7 = 0 AS grown FROM part)"""


def _changes(spark, sf_dir):
    """Two versions of the parts, aligned: added, removed and retyped ones are changes."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    before = p.filter("k % 10 <> 0").select("k", F.col("p_size").alias("b_size"))
    after = p.filter("k % 10 <> 1").select("k", F.when(F.col("k") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("a_size"))
    both = before.join(after, "k", "full_outer")
    kind = (
        F.when(F.col("b_size").isNull(), "openapi.path.added")
        .when(F.col("a_size").isNull(), "openapi.path.removed")
        .when(F.col("a_size") != F.col("b_size"), "openapi.parameter.type_changed")
    )
    path = F.concat(F.lit("/part/"), F.col("k").cast("string"))
    return both.select("k", kind.alias("kind"), F.concat(F.lit("/paths/"), path).alias("location"), path.alias("path"), F.array(F.lit("GET"), F.lit("POST")).alias("methods")).filter("kind IS NOT NULL")


_CHANGES = f"""(SELECT k, '/part/' || CAST(k AS VARCHAR) AS path, CASE WHEN NOT in_before THEN 'openapi.path.added'
  WHEN NOT in_after THEN 'openapi.path.removed' ELSE 'openapi.parameter.type_changed' END AS kind
  FROM {_SETS} WHERE (in_before OR in_after) AND (NOT in_before OR NOT in_after OR grown))"""


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM {_CHANGES} GROUP BY kind")
def contract_diff_sets(spark, sf_dir):
    return _changes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


OWN_RULES = [{"id": "OWN-1", "kind": "openapi.path.removed", "verdict": "behavioral", "rationale": "planned", "location_glob": "/paths//part/*1"}]
_CLASSIFIED = f"""(SELECT c.*, CASE WHEN kind = 'openapi.path.added' THEN 'OAS-PATH-ADDED' WHEN kind = 'openapi.parameter.type_changed' THEN 'OAS-PARAM-TYPE-CHANGED'
   WHEN path LIKE '/part/%1' THEN 'OWN-1' ELSE 'OAS-PATH-REMOVED' END AS rule_id,
  CASE WHEN kind = 'openapi.path.added' THEN 'additive' WHEN kind = 'openapi.path.removed' AND path LIKE '/part/%1' THEN 'behavioral' ELSE 'breaking' END AS verdict FROM {_CHANGES} c)"""


def _classified(spark, sf_dir):
    table_of_rules = rules.rule_table(spark, rules.combine_rules(rules.default_rules(), OWN_RULES))
    return rules.classify(_changes(spark, sf_dir), table_of_rules, ["k"])


@query(f"SELECT k, kind, rule_id, verdict, substr(sha1(kind || '::/paths/' || path), 1, 16) AS change_id FROM {_CLASSIFIED}")
def rule_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("k", "kind", "rule_id", "verdict", "change_id")


_AFFECTED = f"""(SELECT c.k, c.verdict, s.repo FROM {_CLASSIFIED} c JOIN {_SITES} s ON s.path_template = c.path AND s.method IN ('GET', 'POST') GROUP BY 1, 2, 3)"""


def _affected(spark, sf_dir):
    return rules.affected_clients(_classified(spark, sf_dir), call_sites(spark, sf_dir), ["k"])


@query(f"""SELECT c.k, coalesce(string_agg(a.repo, ',' ORDER BY a.repo), '') AS clients FROM {_CLASSIFIED} c LEFT JOIN {_AFFECTED} a ON a.k = c.k GROUP BY c.k""")
def affected_clients(spark, sf_dir):
    return _affected(spark, sf_dir).select("k", F.array_join("affected_clients", ",").alias("clients"))


@query(f"SELECT repo AS client, CAST(count(*) AS BIGINT) AS changes, bool_or(verdict = 'breaking') AS breaking FROM {_AFFECTED} GROUP BY repo")
def client_impact(spark, sf_dir):
    return reports.client_impact(_affected(spark, sf_dir), [])


@query(f"""SELECT repo AS client, CAST(count(*) FILTER (verdict = 'breaking') AS BIGINT) AS breaking, CAST(count(*) FILTER (verdict = 'behavioral') AS BIGINT) AS behavioral,
  CAST(count(*) FILTER (verdict = 'additive') AS BIGINT) AS additive FROM {_AFFECTED} GROUP BY repo""")
def verdict_matrix(spark, sf_dir):
    return reports.verdict_matrix(_affected(spark, sf_dir), [])


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (verdict = 'breaking') AS BIGINT) AS breaking, CAST(count(*) FILTER (verdict = 'behavioral') AS BIGINT) AS behavioral,
  CAST(count(*) FILTER (verdict = 'additive') AS BIGINT) AS additive FROM {_CLASSIFIED}""")
def verdict_summary(spark, sf_dir):
    return reports.verdict_summary(_classified(spark, sf_dir), [])


@query(f"""SELECT position, k, verdict FROM (SELECT CAST(row_number() OVER (ORDER BY CASE verdict WHEN 'breaking' THEN 0 WHEN 'behavioral' THEN 1 ELSE 2 END, k) AS INTEGER) AS position, k, verdict
  FROM {_CLASSIFIED}) WHERE position <= 50""")
def annotations_top50(spark, sf_dir):
    # One report: the top 50 of all is a bounded heap per task, not a window over everything.
    c = _classified(spark, sf_dir)
    top = c.orderBy(reports.verdict_rank(F.col("verdict")), "k").limit(reports.ANNOTATION_LIMIT).withColumn("report", F.lit(1))
    return reports.annotations(top, ["report"], "k").select("position", "k", "verdict")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations) WHERE r <= 3""")
def callsites_topn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sites = c.select(F.col("conv_id").alias("repo"), F.col("turn").alias("file"), F.col("role").alias("line"), F.col("text").alias("method"), F.lit("").alias("path_template"))
    return guides.first_call_sites(sites, limit=3).select(F.col("repo").alias("conv_id"), F.col("file").alias("turn"), F.col("line").alias("role"))


@query(r"""SELECT page_id, href, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def href_mining(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT CAST(count(*) AS BIGINT) AS labels, CAST(count(d.doc_id) AS BIGINT) AS hits, avg(CASE WHEN d.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS recall
FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars >= 500) d ON l.doc_id = d.doc_id""")
def recall(spark, sf_dir):
    from pactlens.operators.mining import recall as measure

    return measure(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("n_chars >= 500"), ["doc_id"])


@query("""SELECT coalesce(a.p, b.p) AS path_template, CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN 'both' WHEN a.p IS NOT NULL THEN 'static' ELSE 'observed' END AS x_source
FROM (SELECT DISTINCT '/' || event_type AS p FROM events) b FULL OUTER JOIN (SELECT '/view' AS p UNION ALL SELECT '/retired') a ON a.p = b.p""")
def defacto_paths(spark, sf_dir):
    static = spark.createDataFrame([("/view",), ("/retired",)], "path_template string")
    return ingest.defacto_paths(static, ingest.observed_endpoints(calls(spark, sf_dir)))


@query("""SELECT event_type AS endpoint_id, 'request' AS role, CASE WHEN bool_and(k IS NOT NULL) THEN '{"properties": {"k": {"type": "integer"}}, "required": ["k"], "type": "object"}'
  WHEN bool_or(k IS NOT NULL) THEN '{"properties": {"k": {"type": "integer"}}, "type": "object"}' ELSE '{"properties": {}, "type": "object"}' END AS schema
FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL) GROUP BY event_type""")
def infer_schema(spark, sf_dir):
    return ingest.infer_schemas(calls(spark, sf_dir), ("endpoint_id",), {"request": "request_body"})


@query(ORACLES["usage_windows"])
def stream_usage(spark, sf_dir):
    """The same rows as the batch query: with all events read, nothing is later than the watermark allows."""
    from pactlens.streaming.usage import usage_by_stream

    w = usage_by_stream(spark, sf_dir)
    return w.withColumn("window_start", _show(F.col("window_start"))).withColumn("window_end", _show(F.col("window_end")))


@query(ORACLES["ewma_decay"])
def stream_ewma(spark, sf_dir):
    from pactlens.streaming.usage import ewma_by_stream

    return ewma_by_stream(spark, sf_dir).withColumn("ewma_value", F.round("ewma_value", 3))


@query(ORACLES["observed_endpoints"])
def stream_endpoints(spark, sf_dir):
    """Observed endpoints of a stream in which every event comes twice."""
    from pactlens.streaming.usage import endpoints_by_stream

    return endpoints_by_stream(spark, sf_dir).withColumn("last_seen_at", _show(F.col("last_seen_at")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field usage by endpoint, path and type, with distinct clients and the latest time."""
    nodes = ingest.field_nodes(calls(spark, sf_dir), ("endpoint_id", "client_id"), {"request": "request_body"})
    return nodes.groupBy("endpoint_id", "path", "type").agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("clients"), F.max("ts").alias("last_seen_at"))
