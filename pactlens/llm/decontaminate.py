"""Benchmark decontamination with spaced seeds.

Each mask looks at some of the word positions of a window and ignores the others, so a window
still hits when an ignored word was substituted.  Hits of documents and benchmark items on the
same hash give diagonals; around them the aligned words are compared and overlaps confirmed.
Short items have masks as long as they are, one of which hits whichever words were substituted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.hashing import ALNUM_SPLIT, U64, Words, mix64, slabs
from pactlens.llm.sparkside import cut, read, unused

#: 1: the word counts, 0: it may differ.  Whatever overlap is accepted with an item of LONG_ITEM words or
#: more, one of these has a window there whose words that count are all equal: of ten equal words or more,
#: at least three to each differing one, no arrangement escapes all four.
MASKS = ("11111", "110111", "100001111", "1101000011")
#: An overlap has at least so many equal words (this share of the item's, if that is less) and at least
#: this share of its length ...
MIN_WORDS = 10
MIN_IDENTITY = 0.75
#: ... which it has just when its equal words are at least so many times its differing ones.
MISMATCH = 3
#: Items with fewer words have fitted masks: with so many, MIN_WORDS are less than MIN_IDENTITY of them.
LONG_ITEM = 13
#: drop_contaminated() drops no document for an item of fewer words: everyday phrases are no leaks.
LEAST_LEAK = 8
#: Up to so many benchmark seeds (16 bytes each) are broadcast as a filter; beyond, all windows are joined.
BROADCAST_SEEDS = 2_000_000
#: Candidates of up to so many numbers (8 bytes each) are broadcast to the documents; beyond, texts are shuffled.
BROADCAST_NUMBERS = 1_000_000


def needed(length: int) -> int:
    """Equal words that an overlap with an item of so many words has at least."""
    return min(MIN_WORDS, -(-length * MISMATCH // (MISMATCH + 1)))


def fitted_masks(length: int) -> list[tuple[str, int]]:
    """Masks for an item of so many words, each with the item's word that it begins at.

    The words are cut into three blocks more than may differ; each mask ignores as many blocks as
    words may differ, so that some mask ignores all that do.
    """
    differ = length - needed(length)
    blocks = np.array_split(np.arange(length), min(length, differ + 3) if differ else 1)
    out = []
    for ignored in combinations(blocks, differ):
        looked_at = sorted(set(range(length)).difference(*(b.tolist() for b in ignored)))
        mask = "".join("1" if p in looked_at else "0" for p in range(looked_at[0], looked_at[-1] + 1))
        out.append((mask, looked_at[0]))
    return out


def _item_masks() -> list[tuple[str, int | None, int]]:
    """(mask, number of words of the items that it is for, the word it begins at) for all items; MASKS, for long ones, anywhere."""
    return [(m, None, 0) for m in MASKS] + [(m, n, at) for n in range(1, LONG_ITEM) for m, at in fitted_masks(n)]


def _windows(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word within the text) of every window of one mask."""
    span = len(mask)
    counts = np.maximum(np.diff(words.first) - span + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place + words.first[:-1][owner]
    h = np.full(len(at), U64(int(mask, 2)), dtype=U64)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ words.hashes[at + j]) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(29)
    return h, owner, place


def _item_seeds(batches):
    """(id, text) of items to (id, mask, hash, pos): windows of MASKS in long items, of fitted masks in short ones."""
    for batch in batches:
        for i, j, data, base in slabs(batch.column(1)):
            words = Words(data, base, ALNUM_SPLIT)
            lengths = np.diff(words.first)
            present = set(lengths.tolist())
            for mask, length, begin in _item_masks():
                if length is not None and length not in present:
                    continue
                h, owner, place = _windows(words, mask)
                fits = lengths[owner] >= LONG_ITEM if length is None else (lengths[owner] == length) & (place == begin)
                h, owner, place = h[fits], owner[fits], place[fits]
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, j - i).take(pa.array(owner)),
                            pa.array([mask] * len(h), type=pa.string()),
                            pa.array(h.view(np.int64)),
                            pa.array(place),
                        ],
                        names=["id", "mask", "hash", "pos"],
                    )


def _seeds(masks, wanted=None):
    """Arrow function: (id, text) to (id, hash, pos); with `wanted`, only hashes in that sorted array."""

    def run(batches):
        keep = None if wanted is None else wanted.value
        if keep is not None:
            bits = 22
            present = np.zeros(1 << bits, dtype=bool)
            present[(keep >> U64(64 - bits)).astype(np.int64)] = True
        for batch in batches:
            for i, j, data, base in slabs(batch.column(1)):
                words = Words(data, base, ALNUM_SPLIT)
                for mask in masks:
                    h, owner, place = _windows(words, mask)
                    if keep is not None:
                        some = np.flatnonzero(present[(h >> U64(64 - bits)).astype(np.int64)])
                        at = np.searchsorted(keep, h[some])
                        at[at == len(keep)] = 0
                        some = some[keep[at] == h[some]] if len(keep) else some[:0]
                        h, owner, place = h[some], owner[some], place[some]
                    if len(h):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(i, j - i).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(place)],
                            names=["id", "hash", "pos"],
                        )

    return run


def _word_lists(batches):
    """(id, text) to (id, words): the hashes of all words of each text."""
    for batch in batches:
        for i, j, data, base in slabs(batch.column(1)):
            words = Words(data, base, ALNUM_SPLIT)
            lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["item", "words"])


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(start in the document, end, equal words) of the stretch of a diagonal with the most equal words.

    Only stretches with MIN_IDENTITY count; of those with as many equal words the shortest is taken.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high <= low:
        return 0, 0, 0
    same = doc[low + diagonal : high + diagonal] == item[low:high]
    if not same.any():
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # For each end the first start whose sum is no higher, then past the differing words that it begins with.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    places = np.flatnonzero(same)
    start = places[np.minimum(np.searchsorted(places, start), len(places) - 1)]
    ends = places + 1
    start = start[ends]
    count = equal[ends] - equal[start]
    best = np.lexsort((ends - start, -count))[0]
    return low + diagonal + int(start[best]), low + diagonal + int(ends[best]), int(count[best])


def _verify(batches):
    for batch in batches:
        out = []
        ids, texts = batch.column(0), batch.column(1)
        for i, j, data, base in slabs(texts):
            words = Words(data, base, ALNUM_SPLIT)
            for r in range(i, j):
                doc = words.hashes[words.first[r - i] : words.first[r - i + 1]]
                for found in batch.column(2)[r].as_py():
                    item = np.array(found["words"], dtype=np.int64).view(U64)
                    best = (0, 0, 0)
                    for diagonal in found["diagonals"]:
                        best = max(best, best_overlap(doc, item, diagonal), key=lambda x: x[2])
                    start, end, equal = best
                    if end > start and equal >= needed(len(item)):
                        out.append((ids[r].as_py(), found["item"], start, end, equal, len(item)))
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=pa.int64()) for c in columns], names=["id", "item", "start_word", "end_word", "equal_words", "item_words"]
        )


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Confirmed overlaps of documents with benchmark items.

    Returns id_col, item_id, start_word, end_word, equal_words, item_words: for each document and
    item the best overlap, where the document's words from start_word up to end_word (not included)
    stand against the item's, at least MIN_WORDS of them equal (MIN_IDENTITY of the item's words, if
    that is less) and at least MIN_IDENTITY of the stretch.  Words are runs of ASCII letters and
    digits and of anything beyond ASCII, lower-cased.  All such overlaps are found; an item of one
    word is found wherever that word stands.  Rows with a null id
    or text, items without a word, and empty tables, give nothing; rows that share an id are versions
    of one document (its best overlap counts); repeated rows give one result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    shape = "id bigint, hash bigint, pos bigint"
    seeds = cut(
        items.mapInArrow(_item_seeds, "id bigint, mask string, hash bigint, pos bigint").select(
            F.col("id").alias("item"), "mask", "hash", F.col("pos").alias("item_pos")
        )
    )
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # those of _item_masks() at most
    hashes = seeds.select("hash").distinct()
    if hashes.count() <= BROADCAST_SEEDS:
        wanted = hashes.toArrow().column("hash").to_numpy().astype(np.int64).view(U64)
        hits = source.mapInArrow(_seeds(masks, spark.sparkContext.broadcast(np.sort(wanted))), shape)
    else:
        hits = source.mapInArrow(_seeds(masks), shape)
    diagonals = (
        hits.join(seeds.drop("mask"), "hash")
        .groupBy("id", "item")
        .agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
    )
    words = items.mapInArrow(_word_lists, "item bigint, words array<bigint>")
    candidates = cut(
        diagonals.join(words, "item").groupBy("id").agg(F.collect_list(F.struct("item", "diagonals", "words")).alias("found"))
    )
    numbers = F.sum(F.aggregate("found", F.lit(4), lambda n, x: n + 4 + F.size(x["diagonals"]) + F.size(x["words"])))
    if (candidates.agg(numbers).first()[0] or 0) <= BROADCAST_NUMBERS:
        candidates = F.broadcast(candidates)
    checked = source.join(candidates, "id").select("id", "text", "found").mapInArrow(
        _verify, "id bigint, item bigint, start_word bigint, end_word bigint, equal_words bigint, item_words bigint"
    )
    best = checked.groupBy("id", "item").agg(
        F.max(F.struct("equal_words", -F.col("start_word"), "start_word", "end_word", "item_words")).alias("b")
    )
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias("item_id"), "b.start_word", "b.end_word", "b.equal_words", "b.item_words"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_LEAK) -> DataFrame:
    """docs without those that overlap with a benchmark item of at least least_words words.

    Rows without an id stay; columns are as in docs, whatever their names.
    """
    leaked = unused(docs, "leaked_id")
    found = find_overlaps(docs, benchmark, id_col, text_col).filter(F.col("item_words") >= least_words)
    found = cut(found.select(F.col(id_col).alias(leaked)).distinct())
    if found.count() <= BROADCAST_NUMBERS:
        found = F.broadcast(found)
    return docs.join(found, F.col(id_col) == F.col(leaked), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents and the benchmark items found in them."""
    return find_overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
