"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes decides where pieces end, each piece gives one character of
a signature, and signatures are compared by edit distance where their block sizes are compatible.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.hashing import U64, mix64
from pactlens.llm.sparkside import read

WINDOW = 7
#: A piece is at least expected to be 2 ** LEAST_LEVEL bytes; levels double it.
LEAST_LEVEL, LEVELS = 2, 40
#: The level is the lowest at which a text has at most so many pieces.
MOST_PIECES = 64
#: Signatures that are not equal must share a run of so many characters to be alike at all.
COMMON = 4
#: Bytes of text that a range of ids should hold, and the most ranges; with more text each holds more.
#: A range is read row by row, so its size is no matter of memory.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000
_FACTOR = 0x9E3779B97F4A7C15 | 1
_LEAST_ID = -(1 << 63)
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
#: Bytes hashed at a time; longer texts go through in steps that overlap by a window.
STEP = 1 << 20


def _triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions after which a piece may end, their levels) for the lowest level and above."""
    places, levels = [], []
    for at in range(0, len(data), STEP):
        low = max(0, at - WINDOW + 1)
        part = data[low : at + STEP].astype(U64) + U64(1)
        h = np.zeros(len(part), dtype=U64)
        with np.errstate(over="ignore"):
            for back in range(WINDOW):
                if back < len(part):
                    h[back:] += part[: len(part) - back] * U64(pow(_FACTOR, back + 1, 1 << 64))
        h = mix64(h)[at - low :]
        here = np.flatnonzero((h & U64((1 << LEAST_LEVEL) - 1)) == 0)
        rest = h[here]
        lowest = rest & (~rest + U64(1))
        level = np.where(rest == 0, LEVELS, np.log2(np.maximum(lowest, U64(1)).astype(np.float64))).astype(np.int64)
        places.append(here + at + 1)
        levels.append(np.minimum(level, LEVELS))
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(levels or [np.zeros(0, np.int64)])


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    """One character per piece of data cut at `ends`."""
    edges = np.unique(np.concatenate([[0], ends, [len(data)]]))
    if len(edges) < 2:
        return ""
    # A piece's value is a polynomial in its own bytes, summed step by step.
    values = np.zeros(len(edges) - 1, dtype=U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), STEP):
            part = data[at : at + STEP].astype(U64) + U64(1)
            piece = np.searchsorted(edges, np.arange(at, at + len(part)), side="right") - 1
            inside = (np.arange(at, at + len(part)) - edges[piece]).astype(U64)
            terms = mix64(part + (inside + U64(1)) * U64(_FACTOR))
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            values[piece[first]] += np.add.reduceat(terms, first)
    return _ALPHABET[(mix64(values) >> U64(58)).astype(np.int64)].tobytes().decode("ascii")


def fingerprint(raw: bytes) -> str:
    """level:signature:signature at the next level.  The whole text counts, whatever its length."""
    data = np.frombuffer(raw, dtype=np.uint8)
    places, levels = _triggers(data)
    counts = np.bincount(levels, minlength=LEVELS + 1)
    above = np.cumsum(counts[::-1])[::-1]
    level = LEAST_LEVEL
    while level < LEVELS and above[level] >= MOST_PIECES:
        level += 1
    return f"{level}:{_signature(data, places[levels >= level])}:{_signature(data, places[levels > level])}"


def _alike(a: Column, b: Column) -> Column:
    """Edit-distance likeness of two signatures; 0 if they share no run of COMMON characters."""
    longest = F.greatest(F.length(a), F.length(b))
    runs = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - (COMMON - 1)), lambda i: F.substring(s, i, COMMON))
    short = F.least(F.length(a), F.length(b)) < COMMON
    shared = F.when(short, F.lit(True)).otherwise(F.arrays_overlap(runs(a), runs(b)))
    ratio = F.lit(1.0) - F.levenshtein(a, b) / longest
    return F.when(longest == 0, F.lit(1.0)).when(a == b, F.lit(1.0)).when(shared, ratio).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the likeness of two fingerprints, 1 for equal ones, 0 where block sizes are not compatible.

    Fingerprints of one level are compared at both of their block sizes, those of neighbouring
    levels at the one they share.
    """
    part = lambda s, i: F.element_at(F.split(s, ":"), i)
    level = lambda s: part(s, 1).cast("int")
    return (
        F.when(a == b, F.lit(1.0))
        .when(level(a) == level(b), F.greatest(_alike(part(a, 2), part(b, 2)), _alike(part(a, 3), part(b, 3))))
        .when(level(a) + 1 == level(b), _alike(part(a, 3), part(b, 2)))
        .when(level(a) == level(b) + 1, _alike(part(a, 2), part(b, 3)))
        .otherwise(F.lit(0.0))
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint of every row; null texts count as empty, equal texts have equal fingerprints."""

    def run(batches):
        for batch in batches:
            raw = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), type=pa.int64()), pa.array([fingerprint(t.encode()) for t in raw], type=pa.string())],
                names=["id", "n_chars", "fingerprint"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, n_chars bigint, fingerprint string").withColumnRenamed("id", id_col)


def id_ranges(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES) -> np.ndarray:
    """Sorted ids that cut the documents into ranges of about range_bytes of text, MOST_RANGES at most."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(MOST_RANGES, max(1, -(-total // range_bytes)))
    if parts == 1:
        return np.zeros(0, dtype=np.int64)
    at = [i / parts for i in range(1, parts)]
    marks = docs.filter(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, at, 10 * parts).alias("m")).first()["m"]
    return np.unique(np.array(marks or [], dtype=np.int64))


def _range_of(ids: pa.Array, marks: np.ndarray) -> np.ndarray:
    """The range of each id; null ids belong to the first."""
    return np.searchsorted(marks, ids.fill_null(_LEAST_ID).to_numpy(), side="right").astype(np.int32)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows in id order within ranges, each range followed by a copy of the row that comes next.

    Returns range, tail, id, size, packed, partitioned by range and sorted; `tail` marks the copy,
    which for the last range is the first row of all; packed is the UTF-8 text, compressed, and size
    its length.  Order is by id (null first), then a hash of the text.  One shuffle of the compressed
    texts; the only rows that move twice are the first ones of each range.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = id_ranges(rows, "id", "text", range_bytes)
    rows = rows.withColumn("place", F.sha2("text", 256))
    firsts = sorted(tuple(r) for r in _first_rows(rows, marks).collect())
    # Each first row also goes to the end of the range before its own; the first of all to the last range's.
    copies = [(i, h, firsts[k - 1][0]) for k, (_, i, h) in enumerate(firsts)]
    table = F.broadcast(docs.sparkSession.createDataFrame(copies, "f_id bigint, f_place string, goes_to int"))
    tails = rows.join(table, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("place") == F.col("f_place"))).dropDuplicates(["f_id", "f_place"])
    both = rows.withColumn("goes_to", F.lit(None).cast("int")).unionByName(tails.select("id", "text", "place", "goes_to"))
    small = both.mapInArrow(_pack(marks), "range int, tail boolean, id bigint, place string, size bigint, packed binary")
    order = ["range", "tail", F.col("id").asc_nulls_first(), "place"]
    return small.repartition(len(marks) + 1, "range").sortWithinPartitions(*order).drop("place")


def _pack(marks: np.ndarray):
    """(id, text, place, goes_to) to rows of with_next; goes_to is the range of a copy, else null."""

    def run(batches):
        for batch in batches:
            ids, texts, place, goes_to = batch.columns
            span = np.where(goes_to.is_null(), _range_of(ids, marks), goes_to.fill_null(0).to_numpy())
            raw = [t.as_buffer() for t in texts]
            packed = [pa.compress(r, codec="zstd", asbytes=True) if len(r) else b"" for r in raw]
            columns = [pa.array(span.astype(np.int32)), goes_to.is_valid(), ids, place, pa.array([len(r) for r in raw], type=pa.int64()), pa.array(packed, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "tail", "id", "place", "size", "packed"])

    return run


def _first_rows(rows: DataFrame, marks: np.ndarray) -> DataFrame:
    """The first row of every range as range, id, place: MOST_RANGES rows at most reach the driver."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(batch.column(0), marks)), *batch.columns], names=["range", "id", "place"])

    key = F.struct(F.coalesce(F.col("id"), F.lit(_LEAST_ID)).alias("o"), "place", "id")
    ranged = rows.select("id", "place").mapInArrow(run, "range int, id bigint, place string")
    return ranged.groupBy("range").agg(F.min(key).alias("k")).select("range", "k.id", "k.place")


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many (or all) of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compare(batches):
    """Rows in order to (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint)."""
    shape = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    held = None
    for batch in batches:
        out = []
        for span, tail, doc, size, packed in zip(*(batch.column(c).to_pylist() for c in range(5))):
            raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
            text, own = raw.decode(), fingerprint(raw)
            if held is not None and held[0] == span:
                _, before, before_text, before_print = held
                changed = edited(before_text, text).encode()
                out.append((before, len(before_text), hashlib.sha256(changed).hexdigest(), before_print, fingerprint(changed), own))
            held = None if tail else (span, doc, text, own)
        columns = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, shape)], names=names)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    compared = with_next(docs).mapInArrow(
        _compare, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    )
    return compared.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
