"""Observed paths matched to route templates by joins with the tree's edges."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pactlens.functions.lineage import cut
from pactlens.functions.names import unused
from pactlens.functions.paths import abstract_static_segments, strip_to_path

#: Stands for a template segment; cannot occur in a path.
_ANY = "\x00"
#: Where every walk begins, above the root.
_START = "\x01"
#: Up to so many routes make a tree whose edges are broadcast.
BROADCAST_ROUTES = 10_000
VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def routes_of_spec(specs: DataFrame, key: str, spec_col: str = "spec") -> DataFrame:
    """key, method, path_template, ord: one row per path and verb; a path without verbs registers GET."""
    items = F.from_json(F.get_json_object(spec_col, "$.paths"), "map<string,string>")
    paths = specs.select(key, F.posexplode(items).alias("ord", "path_template", "item"))
    verbs = F.filter(F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>")), lambda k: F.lower(k).isin(*VERBS))
    methods = F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("GET")))
    return paths.select(key, F.upper(F.explode(methods)).alias("method"), "path_template", "ord")


def _segments(path: Column) -> Column:
    """The root, which is empty, and the segments below it."""
    return F.concat(F.array(F.lit("")), F.filter(F.split(path, "/"), lambda s: s != ""))


def _marked(template: Column) -> Column:
    """Segments of a template, with those that stand for any segment marked."""
    return F.transform(_segments(template), lambda s: F.when(s.rlike(r"\A\{[^}]+\}\z"), F.lit(_ANY)).otherwise(s))


def _node(segments: Column) -> Column:
    return F.when(F.size(segments) > 0, F.array_join(segments, "/")).otherwise(F.lit(_START))


def route_edges(routes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, depth, parent, segment, child, chain: the literal edges of each specification's tree of paths.

    A node is the path from the root with template segments marked; chain is how many template segments
    can follow the child one after another, so that a template step needs no edge of its own.
    """
    paths = routes.select(*keys, _marked(F.col("path_template")).alias("s")).distinct()
    nodes = paths.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.slice("s", F.lit(1), i))).alias("s")).distinct()
    literal = F.array_max(F.transform("s", lambda x, i: F.when(x != _ANY, i + 1)))
    below = nodes.select(*keys, F.posexplode(F.transform(F.sequence(F.size("s"), literal, F.lit(-1)), lambda i: _node(F.slice("s", F.lit(1), i)))).alias("steps", "child"))
    chains = below.groupBy(*keys, "child").agg(F.max("steps").alias("chain"))
    size = F.size("s")
    edges = nodes.filter(F.element_at("s", -1) != _ANY).select(
        *keys, (size - 1).alias("depth"), _node(F.slice("s", F.lit(1), size - 1)).alias("parent"), F.element_at("s", -1).alias("segment"), _node(F.col("s")).alias("child")
    )
    return edges.join(chains, [*keys, "child"])


def match_routes(calls: DataFrame, routes: DataFrame, url_col: str = "url", method_col: str = "method", keys: tuple[str, ...] = ()) -> DataFrame:
    """calls with path_template and matched; columns of these names are replaced, all others kept.

    routes(keys, method, path_template, ord), with columns that tell the specifications of many
    services apart, if there are any: calls are matched to the routes of their own keys.  Paths are
    walked from the root, a literal child before the template child, with no way back.  Of templates
    that share a node the last (by ord) names it, and their methods add up.  Unmatched paths keep their
    own segments, with numbers and UUIDs as {id}; a null URL has a null path and no match.

    The tree is a table of edges that each level of the walk joins once by node and segment.  Up to
    BROADCAST_ROUTES routes are read by the driver and their edges sent to the calls, which then do
    not move; with more, the distinct paths are walked in shuffles and joined to the calls.
    """
    calls = calls.drop("path_template", "matched")
    path, method, found, node = (unused(calls, f"walk_{n}") for n in ("path", "method", "template", "node"))
    located = calls.withColumns({path: strip_to_path(F.col(url_col)), method: F.upper(method_col)})
    columns = [*keys, "method", "path_template", "ord"]
    first = routes.select(*columns).limit(BROADCAST_ROUTES + 1).collect()
    if len(first) <= BROADCAST_ROUTES:
        edges, ends, depth = _small_tree(routes, first, keys)
        walked = _walk(located, edges, path, node, depth, keys)
    else:
        edges = cut(route_edges(routes, keys))
        some = located.select(*keys, path).filter(F.col(path).isNotNull()).distinct()
        walked = _walk(some, edges, path, node, edges.agg(F.max("depth")).first()[0] + 1, keys)
        walked = located.join(walked, [*keys, path], "left")
        by_node = routes.select(*columns, _node(_marked(F.col("path_template"))).alias("node"))
        ends = by_node.groupBy(*keys, "node").agg(F.max_by("path_template", "ord").alias("template"), F.collect_set(F.upper("method")).alias("methods"))
        ends = ends.select(*keys, "node", "template", F.explode("methods").alias("method"))
    joined = walked.join(ends.withColumnsRenamed({"node": node, "template": found, "method": method}), [*keys, node, method], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in calls.columns], F.coalesce(found, abstract_static_segments(F.col(path))).alias("path_template"), F.col(found).isNotNull().alias("matched")
    )


def _small_tree(routes: DataFrame, rows: list, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, int]:
    """Edges as route_edges() has them, ends (keys, node, template, method), and the depth of the tree, of few routes."""
    nodes, names, methods = set(), {}, set()
    for *key, method, template, order in rows:
        path = ("", *(_ANY if re.fullmatch(r"\{[^}]+\}", s) else s for s in template.split("/") if s))
        nodes |= {(*key, path[:n]) for n in range(1, len(path) + 1)}
        names[*key, path] = max(names.get((*key, path), (order, template)), (order, template))
        methods.add((*key, path, method.upper()))
    chains: dict = {}
    for *key, path in nodes:
        below = path
        while below[-1] == _ANY:
            below = below[:-1]
            chains[*key, below] = max(chains.get((*key, below), 0), len(path) - len(below))
    edges = [(*key, len(path) - 1, "/".join(path[:-1]) if path[:-1] else _START, path[-1], "/".join(path), chains.get((*key, path), 0)) for *key, path in nodes if path[-1] != _ANY]
    ends = [(*key, "/".join(path), names[*key, path][1], method) for *key, path, method in methods]
    kinds = [routes.schema[k] for k in keys]
    local = lambda data, shape: F.broadcast(routes.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(shape.names, r)) for r in data], schema=to_arrow_schema(shape)), shape))
    texts = lambda *names: T.StructType([*kinds, *[T.StructField(n, T.IntegerType() if n in ("depth", "chain") else T.StringType()) for n in names]])
    depth = max((len(path) for *_, path in nodes), default=0)
    return local(edges, texts("depth", "parent", "segment", "child", "chain")), local(ends, texts("node", "template", "method")), depth


def _walk(paths: DataFrame, edges: DataFrame, path: str, node: str, depth: int, keys: tuple[str, ...]) -> DataFrame:
    """paths with the node at which the walk of `path` ends; null if it gets stuck."""
    step = unused(paths, "walk_step")
    out = paths.withColumn(step, F.struct(_segments(F.col(path)).alias("s"), F.lit(_START).alias("node"), F.lit(0).alias("chain")))
    clash = {k: unused(out, f"edge_{k}") for k in keys}
    edges = edges.withColumnsRenamed(clash)
    for level in range(depth):
        here = edges.filter(F.col("depth") == level).select(*clash.values(), F.struct("parent", "segment", "child", "chain").alias(node))
        at, edge = F.col(step), F.col(node)
        same = (at["node"] == edge["parent"]) & (F.get(at["s"], F.lit(level)) == edge["segment"])
        for k, c in clash.items():
            same &= F.col(k) == F.col(c)
        over = F.size(at["s"]) <= level
        by_template = at["chain"] > 0
        to = F.when(over, at["node"]).when(edge["child"].isNotNull(), edge["child"]).when(by_template, F.concat(at["node"], F.lit(f"/{_ANY}")))
        chain = F.when(over, at["chain"]).when(edge["child"].isNotNull(), edge["chain"]).when(by_template, at["chain"] - 1)
        out = out.join(here, same, "left").withColumn(step, F.struct(at["s"].alias("s"), to.alias("node"), chain.alias("chain"))).drop(node, *clash.values())
    # Longer paths than any route end nowhere.
    return out.withColumn(node, F.when(F.size(F.col(step)["s"]) <= depth, F.col(step)["node"])).drop(step)
