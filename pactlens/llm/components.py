"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.sparkside import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node of `edges(a bigint, b bigint)` can reach.

    Returns node, component: one row per node of an edge, its own component's smallest node
    included.  Loops and repeated edges are harmless; edges with a null end are dropped; an empty
    table gives an empty result.

    Alternates two star steps: every node hands its larger neighbours to its smallest one, then its
    smaller neighbours.  Both are a minimum with map-side combining and a join, so no node's
    neighbours are ever gathered in one place, and a hub's rows can be split by adaptive execution.
    The number of rounds grows with the logarithm of the longest chain.
    """
    work = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND u > v")
        .distinct()
    )
    for _ in range(max_rounds):
        if _is_settled(work):
            break
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        work = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one smallest node that itself hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("root"))
    )
    seen = ends.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if(F.col("root").isNull()).alias("hung_on"))
    return seen.filter("lo < hi OR (lo IS NOT NULL AND hung_on > 0)").isEmpty()
