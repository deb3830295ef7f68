"""MinHash near-duplicate detection with tensored banding.

A table key is a pair of half keys, one from each of two small collections, so 8 x 12 tables of
five minhashes each take 8 * 2 + 12 * 3 = 52 minhashes instead of 480.  Texts that share a table
key are candidates; every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.llm.components import connected_components
from pactlens.llm.hashing import BLANK_SPLIT, U64, Words, mix64, slabs
from pactlens.llm.sparkside import cut, read, unused

#: Half keys of each collection and minhashes in each.  At a similarity of 0.8 a pair is missed with
#: probability 1 - (1 - (1 - 0.8**2)**8) * (1 - (1 - 0.8**3)**12), about 0.0005.
LEFT, LEFT_ROWS, RIGHT, RIGHT_ROWS = 8, 2, 12, 3
#: Shingles are also counted in so many bins, and in a few coarser ones; equal shingles fall into
#: equal bins, so the bins bound what two sets share.
BINS, COARSE, FULL = 256, 64, 32767


def _sets(texts, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(from, sorted distinct shingle hashes of all texts of a slab, where each text's begin)."""
    for i, _, data, base in slabs(texts):
        grams, first = Words(data, base, BLANK_SPLIT).grams(k)
        owner = np.repeat(np.arange(len(base) - 1), np.diff(first))
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        yield i, grams, np.searchsorted(owner, np.arange(len(base)))


def _set_hashes(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, as two sums of mixed hashes (0, 0 for an empty one)."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (U64(0xA5A5A5A5), U64(0x5A5A5A5A5A)):
            total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix64(grams ^ seed), dtype=U64)])
            out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _minhash(grams: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """count x texts minima; texts without shingles keep the largest value."""
    has = np.flatnonzero(np.diff(first) > 0)
    out = np.full((count, len(first) - 1), np.iinfo(np.uint64).max, dtype=U64)
    if not len(has):
        return out
    at = first[has]
    with np.errstate(over="ignore"):
        seeds = mix64(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        for j, seed in enumerate(seeds):
            # The shingle hashes are mixed already: an odd factor and a folded shift permute them anew.
            h = grams * seed
            h ^= h >> U64(32)
            h *= seed
            out[j, has] = np.minimum.reduceat(h, at)
    return out


def _half_keys(minima: np.ndarray, halves: int, rows: int, seed: int) -> np.ndarray:
    out = np.empty((minima.shape[1], halves), dtype=U64)
    for j in range(halves):
        h = np.full(minima.shape[1], U64(seed + j), dtype=U64)
        for r in range(rows):
            h = mix64(h ^ minima[j * rows + r])
        out[:, j] = h
    return out.view(np.int64)


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, grams, first in _sets(texts, k):
                m = len(first) - 1
                minima = _minhash(grams, first, LEFT * LEFT_ROWS + RIGHT * RIGHT_ROWS)
                left = _half_keys(minima[: LEFT * LEFT_ROWS], LEFT, LEFT_ROWS, 1)
                right = _half_keys(minima[LEFT * LEFT_ROWS :], RIGHT, RIGHT_ROWS, 1001)
                both = np.concatenate([left, right], axis=1)
                low, high = _set_hashes(grams, first)
                wide = LEFT + RIGHT
                halves = pa.ListArray.from_arrays(np.arange(0, (m + 1) * wide, wide, dtype=np.int32), both.ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, m), pa.array(np.diff(first)), pa.array(low), pa.array(high), halves],
                    names=["id", "n", "low", "high", "halves"],
                )

    return run


def _bodies(k: int):
    """Shingle sets and their bin counts, for the rows whose set is the one asked for."""

    def run(batches):
        for batch in batches:
            for i, grams, first in _sets(batch.column(1), k):
                m = len(first) - 1
                low, high = _set_hashes(grams, first)
                want_low = batch.column(2).slice(i, m).to_numpy(zero_copy_only=False)
                want_high = batch.column(3).slice(i, m).to_numpy(zero_copy_only=False)
                good = np.flatnonzero((low == want_low) & (high == want_high))
                lengths = np.diff(first)[good]
                inside = np.repeat((low == want_low) & (high == want_high), np.diff(first))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                body = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[inside].view(np.int64)))
                place = np.repeat(np.arange(m), np.diff(first)) * BINS + (grams & U64(BINS - 1)).astype(np.int64)
                counts = np.bincount(place, minlength=m * BINS).reshape(m, BINS)[good]
                bins = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(good) + 1) * BINS, BINS, dtype=np.int32)), pa.array(np.minimum(counts, FULL).ravel().astype(np.int16)))
                folded = counts.reshape(-1, BINS // COARSE, COARSE).sum(axis=1)
                coarse = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(good) + 1) * COARSE, COARSE, dtype=np.int32)), pa.array(np.minimum(folded, FULL).ravel().astype(np.int16)))
                ids = batch.column(0).slice(i, m).take(pa.array(good))
                yield pa.RecordBatch.from_arrays([ids, body, bins, coarse], names=["id", "body", "bins", "coarse"])

    return run


def _confirm(batches):
    """Keep the pairs whose sets share at least 80 of 100 of their union."""
    for batch in batches:
        keep = []
        (a_all, a_at), (b_all, b_at) = (
            (batch.column(c).values.to_numpy().view(U64), batch.column(c).offsets.to_numpy()) for c in (2, 3)
        )
        for r in range(batch.num_rows):
            a, b = a_all[a_at[r] : a_at[r + 1]], b_all[b_at[r] : b_at[r + 1]]
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(long, short)
            at[at == len(long)] = 0
            shared = int(np.count_nonzero(long[at] == short))
            keep.append(100 * shared >= 80 * (len(a) + len(b) - shared))
        keep = pa.array(keep, type=pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a shingle similarity of 0.8 or more.

    docs: a bigint id and a text; other columns are ignored.  Returns id_col, n_shingles,
    component_id, kept: one row per input row, the component being the smallest id reachable over
    links and `kept` whether that is the row's own.

    Words are runs without blanks, ASCII letters lower-cased; shingles are runs of `words` words of
    the whole text, as a set; a shorter text is one shingle.  Null or blank texts have an empty set
    and are linked with nothing.  Equal sets are linked without comparing pairs.  Rows that share
    an id are versions of one document and fall into one component.  Rows without an id are linked
    with nothing, have a null component and are kept.  An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketches = cut(source.mapInArrow(_sketch(words), "id bigint, n bigint, low bigint, high bigint, halves array<bigint>"))

    sets = sketches.filter("n > 0 AND id IS NOT NULL")
    nodes = cut(
        sets.groupBy("n", "low", "high").agg(F.min("id").alias("node"), F.first("halves").alias("halves"))
    )
    copies = sets.select("n", "low", "high", "id").join(nodes.select("n", "low", "high", "node"), ["n", "low", "high"])
    copies = copies.filter("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()

    # With fewer than four shingles only equal sets reach 0.8.
    left = F.slice("halves", 1, LEFT)
    right = F.slice("halves", LEFT + 1, RIGHT)
    keys = F.flatten(F.transform(left, lambda x, i: F.transform(right, lambda y, j: F.xxhash64(i, x, j, y))))
    tables = nodes.filter("n >= 4").select("node", "n", F.explode(keys).alias("key"))
    shared = tables.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    live = cut(tables.join(shared.select("key"), "key", "left_semi"))

    links = _links(source, nodes, live, words)
    found = connected_components(copies.unionByName(links))
    result = (
        sketches.select("id", "n")
        .join(found, F.col("id") == F.col("node"), "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _links(source: DataFrame, nodes: DataFrame, live: DataFrame, words: int) -> DataFrame:
    """Confirmed links that join whatever the shared tables can join.

    Each member of a table is first compared with one of them; members that turn out to be in one
    component need no further comparison.  What is then still apart within a table is compared pair
    by pair, each pair once and only if the bin counts leave room for a link.  That bound holds for
    every pair, so no link that would join two components is lost.
    """
    wanted = nodes.join(live.select("node").distinct(), "node", "left_semi").select("node", "low", "high")
    bodies = cut(
        source.join(wanted, F.col("id") == F.col("node"))
        .select("id", "text", "low", "high")
        .mapInArrow(_bodies(words), "id bigint, body array<bigint>, bins array<smallint>, coarse array<smallint>")
    )
    hub = live.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("hub"))
    hub = hub.select("key", F.col("hub.node").alias("hub_node"), F.col("hub.n").alias("hub_n"))
    pairs = live.join(hub, "key").filter("node <> hub_node AND 100 * least(n, hub_n) >= 80 * greatest(n, hub_n)")
    links = cut(_confirmed(pairs.select(F.col("node").alias("x"), F.col("hub_node").alias("y")), bodies))
    found = connected_components(links)
    state = live.join(found, "node", "left").select("node", "n", "key", F.coalesce("component", "node").alias("comp"))
    apart = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    loose = state.join(apart, "key", "left_semi").select("node", "n", "comp").distinct()
    loose = loose.join(nodes.select("node", "halves"), "node").join(bodies.select(F.col("id").alias("node"), "bins", "coarse"), "node")
    # Whoever shares a table shares a left half: these are joined, and the right halves are compared there.
    lanes = cut(loose).select("*", F.posexplode(F.slice("halves", 1, LEFT)).alias("lane", "half"))
    low = lanes.groupBy("lane", "half").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("lane", "half", "lo")
    x, y = lanes.join(low, ["lane", "half"]).filter("comp <> lo").alias("x"), lanes.alias("y")
    equal = lambda at, wide: F.zip_with(F.slice("x.halves", at, wide), F.slice("y.halves", at, wide), lambda a, b: a == b)
    most = lambda c: F.aggregate(F.zip_with(f"x.{c}", f"y.{c}", lambda a, b: F.least(a, b)), F.lit(0), lambda total, v: total + v.cast("int"))
    # 100 * shared >= 80 * union, where the union is n + n - shared; without a bound where a bin may be full.
    full = F.least("x.n", "y.n") > FULL
    room = lambda c: full | (180 * most(c) >= 80 * (F.col("x.n") + F.col("y.n")))
    tests = [
        (F.col("x.lane") == F.col("y.lane")) & (F.col("x.half") == F.col("y.half")) & (F.col("x.comp") != F.col("y.comp")),
        F.col("x.n").between(F.col("y.n") * 0.8 - 1, F.col("y.n") / 0.8 + 1),
        F.array_position(equal(1, LEFT), F.lit(True)) == F.col("x.lane") + 1,
        F.array_contains(equal(LEFT + 1, RIGHT), F.lit(True)),
        room("coarse"),
        room("bins"),
    ]
    pairs = x.join(y, reduce(lambda a, b: a & b, tests))
    last = _confirmed(pairs.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")), bodies)
    return links.unionByName(cut(last))


def _confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The linked ones of pairs(x, y), each once, as (a, b) with a below b."""
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = bodies.select(F.col("id").alias("a"), F.col("body").alias("a_body"))
    second = bodies.select(F.col("id").alias("b"), F.col("body").alias("b_body"))
    return (
        pairs.join(first, "a").join(second, "b").select("a", "b", "a_body", "b_body").mapInArrow(_confirm, "a bigint, b bigint")
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of every component: the one with the smallest id.

    Of rows that share the id of a kept document, the one with the smallest text stays.  Rows
    without an id stay.  Columns are as in docs.
    """
    seen, rank = unused(docs, "judged_id"), unused(docs, "version_rank")
    verdict = cut(near_duplicates(docs, words, id_col, text_col).select(F.col(id_col).alias(seen), "kept"))
    removed = verdict.filter("NOT kept").select(seen).distinct()
    out = docs.join(removed, F.col(id_col) == F.col(seen), "left_anti")
    repeated = cut(verdict.filter(F.col("kept") & F.col(seen).isNotNull()).groupBy(seen).agg(F.count("*").alias("n")).filter("n > 1").select(seen))
    if not repeated.isEmpty():
        some = out.join(repeated, F.col(id_col) == F.col(seen), "left_semi")
        one = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
        some = some.withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1).drop(rank)
        out = out.join(repeated, F.col(id_col) == F.col(seen), "left_anti").unionByName(some)
    return out


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles over all documents."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


#: Candidates share one of the rarest shingles of each set: two sets with a similarity of 0.8 share
#: at least 0.8 of the larger, so the first n - ceil(0.8 n) + 1 of one order of all shingles have one in common.
OP3_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM worded
), nodes AS (
  SELECT min(doc_id) AS node, h, any_value(s) AS s FROM (SELECT doc_id, s, list_sort(s) AS h FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL) GROUP BY h
), ranked AS (
  SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY f, x) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM (SELECT node, len(s) AS n, unnest(s) AS x FROM nodes))
), prefix AS (
  SELECT node, n, x FROM ranked WHERE place <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1
), candidates AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), pairs AS (
  SELECT a, b, len(p.s) AS n, len(q.s) AS m, len(list_intersect(p.s, q.s)) AS shared
  FROM candidates JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b
), linked AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (n + m - shared)
), edges AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(node, seen) AS (
  SELECT node, node FROM nodes UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node
), components AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
), found AS (
  SELECT d.doc_id, len(d.s) AS n, c.component
  FROM (SELECT doc_id, s, list_sort(s) AS h FROM sets) d
  LEFT JOIN nodes ON nodes.h = d.h AND d.doc_id IS NOT NULL LEFT JOIN components c ON c.node = nodes.node
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(doc_id = component, true) AS kept FROM found
"""
