"""Toxicity: a sparse classifier regularised by counterfactuals.

Labelled texts in which identity terms are swapped, for each other or for nothing, should score as
before: the squared change of the score is part of the loss, so that neutral mentions of a group do
not count as toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.hashing import ALNUM_SPLIT, U64, Words, _hash_spans, slabs
from pactlens.llm.sparkside import crc_mod, read

#: At most so many labelled rows are fitted, chosen by a hash of the id.
MOST_ROWS = 10000
BITS = 18
#: Besides whole words, their first bytes at these lengths are features, for words not seen in training.
PREFIXES = (4, 5, 6)
#: Weight of the counterfactual penalty, of the l1 term, and the toxic rows' weight against the others'.
COUNTERFACTUAL, SPARSITY, TOXIC_WEIGHT = 1.0, 4e-4, 3.0
ROUNDS, LEAST_ROWS = 300, 3

#: Identity terms that are swapped for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)
_SWAPS = {word: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, word in enumerate(kind)}
_TERM = re.compile(rf"(?ai)\b(?:{'|'.join(sorted(_SWAPS, key=len, reverse=True))})\b")


def swap_identities(text: str) -> str:
    """The text with every identity term replaced by the next of its kind."""
    return _TERM.sub(lambda m: _SWAPS[m[0].lower()], text)


def without_identities(text: str) -> str:
    """The text with every identity term left out."""
    return _TERM.sub(" ", text)


def presence_features(data: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature buckets of every text of a slab, and where each text's begin."""
    words = Words(data, base, ALNUM_SPLIT)
    owner, length = words.owner(), words.end - words.start
    found, owners = [words.hashes], [owner]
    for n in PREFIXES:
        at = np.flatnonzero(length > n)
        found.append(_hash_spans(words.data, words.start[at], words.start[at] + n) ^ U64(0x1234567 * n))
        owners.append(owner[at])
    key = (np.concatenate(owners).astype(U64) << U64(BITS)) | (np.concatenate(found) >> U64(64 - BITS))
    key = np.unique(key)
    return (key & U64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(base), dtype=U64) << U64(BITS))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = np.full(len(first) - 1, self.bias)
        has = np.flatnonzero(np.diff(first))
        if len(has):
            z[has] += np.add.reduceat(self.weights[features], first[:-1][has], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], swapped: list[tuple[int, np.ndarray]], toxic: np.ndarray) -> ToxicityModel:
    """Accelerated proximal gradient on logistic loss, counterfactual penalty and an l1 term.

    rows are sorted distinct features of each text, swapped pairs of a text's place in rows and the
    features of one of its counterfactuals.  Features of fewer than LEAST_ROWS texts get no weight.  Without rows of
    both kinds the score is a constant on the side of the only kind (0.25 without any rows).
    """
    if not len(rows) or toxic.all() or not toxic.any():
        return ToxicityModel(np.zeros(1 << BITS, np.float32), 1.0 if len(rows) and toxic.all() else -1.1)
    support = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    for i, other in swapped:  # a swapped-in term is held to its counterpart even if no text has it
        support[other] = np.maximum(support[other], LEAST_ROWS * np.isin(other, rows[i], invert=True))
    used = np.flatnonzero(support >= LEAST_ROWS)
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    x = _Sparse(rows, place, len(used))
    same, other = _Sparse([rows[i] for i, _ in swapped], place, len(used)), _Sparse([o for _, o in swapped], place, len(used))
    y = toxic.astype(np.float64)
    importance = np.where(toxic, TOXIC_WEIGHT, 1.0)
    importance = importance / importance.sum()
    # The penalty's curvature is at most twice its weight times the mean number of features that a swap changes.
    curvature = np.sqrt(np.diff(x.first).mean() + 1) / 4
    if swapped:
        curvature += 2 * COUNTERFACTUAL * np.mean([len(np.setxor1d(rows[i], o)) for i, o in swapped])
    step = 1.0 / curvature
    w, v, bias, bias_v = np.zeros(len(used)), np.zeros(len(used)), -1.0, -1.0
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x.dot(v) + bias_v, -30, 30)))
        pull = importance * (p - y)
        grad, grad_bias = x.back(pull), pull.sum()
        if swapped:
            change = (other.dot(v) - same.dot(v)) * (2 * COUNTERFACTUAL / len(swapped))
            grad = grad + other.back(change) - same.back(change)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * SPARSITY, 0)
        new_bias = bias_v - step * grad_bias
        if grad @ (new - w) > 0:  # restart the acceleration when it points uphill
            w, bias = new, new_bias
            v, bias_v = new, new_bias
            step *= 0.9
            continue
        beta = t / (t + 3)
        v, bias_v = new + beta * (new - w), new_bias + beta * (new_bias - bias)
        w, bias = new, new_bias
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[used] = w
    return ToxicityModel(weights, float(bias))


class _Sparse:
    """Rows of present features, as a 0/1 matrix."""

    def __init__(self, rows: list[np.ndarray], place: np.ndarray, width: int):
        kept = [p[p >= 0] for p in (place[r] for r in rows)]
        self.at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(kept)), np.diff(self.first))
        self.width = width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.at], minlength=len(self.first) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=r[self.owner], minlength=self.width)


def _train_rows(batches):
    """(label, text) to (label, features, features of each counterfactual, none without identity terms)."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        versions = [texts, [swap_identities(t) for t in texts], [without_identities(t) for t in texts]]
        found = []
        for strings in versions:
            lists = []
            for _, _, data, base in slabs(pa.array(strings, type=pa.large_string())):
                features, first = presence_features(data, base)
                lists += [features[a:b] for a, b in zip(first[:-1], first[1:])]
            found.append(lists)
        other = [[found[1][i], found[2][i]] if versions[2][i] != t else [] for i, t in enumerate(texts)]
        kind = pa.list_(pa.int32())
        columns = [batch.column(0), pa.array(found[0], type=kind), pa.array(other, type=pa.list_(kind))]
        yield pa.RecordBatch.from_arrays(columns, names=["label", "x", "other"])


def train_toxicity_model(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Fit on at most MOST_ROWS labelled rows that are `usable`; null labels and texts are left out."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("bigint").alias("label")).filter(
        usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    )
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(MOST_ROWS)  # bounded, so it can be broadcast
    rows = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), id_col)
    found = rows.select("label", text_col).mapInArrow(_train_rows, "label bigint, x array<int>, other array<array<int>>").toArrow()
    features = [np.array(x, dtype=np.int32) for x in _each(found.column("x"))]
    swapped = [(i, np.array(o, dtype=np.int32)) for i, others in enumerate(found.column("other").to_pylist()) for o in others]
    return fit(features, swapped, np.array(found.column("label").to_pylist(), dtype=np.int64) > 0)


def _each(column: pa.ChunkedArray):
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with toxicity in [0, 1]; null texts count as empty.

    Every row is kept with its columns; one named toxicity is replaced.
    """
    model_ref = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2 ** BITS numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [ToxicityModel(**model_ref.value).scores(*presence_features(d, b)) for _, _, d, b in slabs(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.drop("toxicity").withColumn("toxicity", score(F.col(text_col)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = train_toxicity_model(docs, read(spark, sf_dir, "labels"), ~held_out)
    found = score_toxicity(docs, model).withColumnRenamed("toxicity", "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
