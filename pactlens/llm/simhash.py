"""SimHash near-duplicate detection over an inverted index of byte positions.

Fingerprints of 64 bits that differ in at most two bits share at least six of their eight bytes,
position by position.  The index therefore lists fingerprints under every six positional bytes they
hold.  A pair's tally is the number of positions whose bytes it was seen to share in the lists where
it met; pairs that reach six are verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.components import connected_components
from pactlens.llm.hashing import BLANK_SPLIT, U64, Words, slabs
from pactlens.llm.sparkside import cut, read

SEED = 42
#: Fingerprints that differ in at most so many bits are linked, so so many of the bytes are equal at least.
MOST_BITS, BYTES = 2, 8
LEAST_BYTES = BYTES - MOST_BITS
#: Within a list two bytes are free.  Its pairs are listed up to so many members; from there on it takes
#: fewer rows to list each member under itself and the 16 fingerprints that differ in one free bit.
MOST_PAIRED = 34
#: _SPREAD[b] holds bit i of b in byte i, so that up to 255 of them can be added in one word.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=U64)
_SETS = list(combinations(range(BYTES), LEAST_BYTES))


def _joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends there."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[end] = False
    held = np.zeros(len(words.data) + 1, dtype=np.int8)
    np.add.at(held, words.start, 1)
    np.add.at(held, words.end, -1)
    out[inside] = words.data[np.cumsum(held[:-1]).astype(bool)]
    return out.tobytes(), start, end


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x 64: how many of each text's hashes have each bit set."""
    lengths = np.diff(first)
    parts = -(-lengths // 255)
    owner = np.repeat(np.arange(len(lengths)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    out = np.zeros((len(lengths), 64), dtype=np.int64)
    if not len(owner):
        return out
    begin = first[:-1][owner] + 255 * within
    some = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for byte in range(BYTES):
        lanes = np.add.reduceat(_SPREAD[((hashes >> U64(8 * byte)) & U64(255)).astype(np.intp)], begin)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[owner[some], 8 * byte : 8 * byte + 8] = np.add.reduceat(counts, some, axis=0)
    return out


def _fingerprints(words: int):
    """Arrow function: (id, text) to (id, fingerprint)."""

    def run(batches):
        for batch in batches:
            for i, j, data, base in slabs(batch.column(1)):
                w = Words(data, base, BLANK_SPLIT)
                text, start, end = _joined(w)
                counts = np.diff(w.first)
                grams = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
                first = np.concatenate([[0], np.cumsum(grams)])
                at = np.arange(first[-1]) - np.repeat(first[:-1], grams) + np.repeat(w.first[:-1], grams)
                last = np.minimum(at + words, np.repeat(w.first[1:], grams)) - 1
                digest = xxhash.xxh64_intdigest
                hashes = np.array([digest(text[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist())], dtype=U64)
                bits = 2 * _votes(hashes, first) > grams[:, None]
                prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel() if j > i else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(prints)], names=["id", "print"])

    return run


def simhash(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, print: the fingerprint of every row as a bigint.

    Words are runs without blanks, ASCII letters lower-cased; shingles are runs of `words` words with
    one space between, repeats included; a shorter text is one shingle.  A bit is set if it is in more
    than half of the shingles' XXH64.  Null and blank texts have the fingerprint zero.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_fingerprints(words), "id bigint, print bigint")


def _byte(column: str, position: int) -> Column:
    return F.shiftrightunsigned(F.col(column), 8 * position).bitwiseAND(255)


def _index(prints: DataFrame) -> DataFrame:
    """key, print: one row per fingerprint and set of six positions; the key holds the set and its bytes."""
    keys = []
    for number, positions in enumerate(_SETS):
        key = F.lit(number << (8 * LEAST_BYTES))
        for place, position in enumerate(positions):
            key = key.bitwiseOR(F.shiftleft(_byte("print", position), 8 * place))
        keys.append(key)
    return prints.select("print", F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints of `prints` that differ in at most two bits.

    The pairs connect whatever such pairs can connect; within long lists not all are given.  Lists of
    up to MOST_PAIRED members give their pairs, which are tallied, filtered and verified.  A longer
    list, as of one family of copies, lists each member under all fingerprints that differ from it in
    at most one bit of the two free bytes: members found under the same one differ in two bits at
    most, and all that do are found so.  Such a place has 17 members at most, so no group grows.
    """
    postings = _index(prints)
    sizes = postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    listed = cut(postings.join(sizes, "key"))

    short = listed.filter(F.col("members") <= MOST_PAIRED).groupBy("key").agg(F.sort_array(F.collect_list("print")).alias("m"))
    pairs = short.select("key", F.posexplode("m").alias("at", "a"), "m").select("key", "a", F.explode(F.expr("slice(m, at + 2, size(m))")).alias("b"))
    masks = F.array(*[F.lit(sum(1 << p for p in s)) for s in _SETS])
    seen = F.element_at(masks, (F.shiftrightunsigned("key", 8 * LEAST_BYTES) + 1).cast("int"))
    tallied = pairs.groupBy("a", "b").agg(F.bit_or(seen).alias("shared")).filter(F.bit_count("shared") >= LEAST_BYTES)
    verified = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS).select("a", "b")

    free = F.array(*[F.array(*[F.lit(_signed(1 << (8 * p + i))) for p in range(BYTES) if p not in s for i in range(8)]) for s in _SETS])
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.element_at(free, (F.shiftrightunsigned("key", 8 * LEAST_BYTES) + 1).cast("int")))
    long = listed.filter(F.col("members") > MOST_PAIRED).select("key", "print", F.explode(flips).alias("flip"))
    places = long.groupBy("key", F.col("print").bitwiseXOR(F.col("flip")).alias("near")).agg(F.collect_list("print").alias("m")).filter("size(m) > 1")
    stars = places.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b").distinct()
    return verified.unionByName(stars)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_copies(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint, component_id of every row: rows whose fingerprints link, directly or over others.

    fingerprint is 16 lowercase hex digits; component_id the smallest id reachable.  Equal fingerprints
    are linked without comparing rows, null and blank texts with all whose fingerprint is near zero.
    Rows without an id count as links between others; they get the component's smallest id, null if
    it has none.  Repeated rows stay repeated; an empty table gives an empty result.
    """
    found = cut(simhash(docs, words, id_col, text_col))
    nodes = cut(found.groupBy("print").agg(F.min("id").alias("least")))
    groups = connected_components(links(nodes.select("print")))
    rooted = nodes.join(groups, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("print").alias("p"), "component_id")
    result = found.join(named, F.col("print") == F.col("p"))
    return result.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles over all documents; rows, null and blank texts and missing ids as near_copies() has them."""
    return near_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))
