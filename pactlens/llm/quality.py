"""Quality scores from preference pairs (Bradley-Terry), cut at a quantile of the scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.hashing import BLANK_SPLIT, Words, byte_table, slabs
from pactlens.llm.sparkside import crc_mod, cut, read

#: Scores are counted in bins of this width, wider if more than BINS would be needed; rounds of the fit at most.
BIN, BINS, ROUNDS = 1 / 128, 4000, 60
#: The score that stands at the quantile: from here on a text counts as good.
CUT = 0.7

_LINES = byte_table([(0x0A, 0x0A), (0x0D, 0x0D)])


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Shares of a text's bytes, by class.
_CLASSES = (
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))),
    _class(bytes(range(48, 58))),
    _class(bytes(range(128, 256))),
    _class(b" \t\r\n"),
    _class(b".,;:'\"-()"),
    _class(b"!?"),
    _class(b"*#$%&@^~_=+"),
    _class(b"|<>[]{}\\/`"),
)
FEATURES = len(_CLASSES) + 8


def text_features(data: np.ndarray, base: np.ndarray) -> np.ndarray:
    """texts x FEATURES: shares of byte classes, word repeats, line repeats and lengths of whole texts."""
    size = np.diff(base)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), FEATURES))
    for c, table in enumerate(_CLASSES):
        if len(some):
            out[some, c] = np.add.reduceat(table[data].astype(np.int64), base[:-1][some]) / size[some]
    words = Words(data, base, BLANK_SPLIT, lower=False)
    lines = Words(data, base, _LINES, lower=False)
    c = len(_CLASSES)
    n = np.maximum(np.diff(words.first), 1)
    length = words.end - words.start
    owner = words.owner()
    add = lambda x, w=owner: np.bincount(w, weights=x, minlength=len(size))
    last = words.data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    mark = ~(_CLASSES[0] | _CLASSES[1] | _CLASSES[2] | _CLASSES[3] | _CLASSES[5])
    repeat = np.zeros(len(owner))
    repeat[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, c] = add(repeat) / n
    out[:, c + 1] = _distinct(words.hashes, owner, len(size)) / n
    out[:, c + 2] = np.minimum(add(length) / n, 30) / 10
    out[:, c + 3] = add((length == 1).astype(float)) / n
    out[:, c + 4] = add(mark[last].astype(float)) / n
    out[:, c + 5] = np.log1p(np.diff(words.first)) / 5
    lines_n = np.maximum(np.diff(lines.first), 1)
    out[:, c + 6] = _distinct(lines.hashes, lines.owner(), len(size)) / lines_n
    out[:, c + 7] = np.diff(words.first) == 0
    return out


def _distinct(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=texts)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.normal(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, x: the features of every text."""

    def run(batches):
        for batch in batches:
            for i, j, data, base in slabs(batch.column(1)):
                x = text_features(data, base)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=[id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(-1, FEATURES)


def _sums(rows: DataFrame, of) -> dict[int, np.ndarray]:
    """FEATURES + 1 totals over all rows(good, x) for every key; of(x, good) gives keys and their values in one batch."""
    names = [f"v{k}" for k in range(FEATURES + 1)]

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(*of(_matrix(batch), batch.column("good").to_numpy(zero_copy_only=False))):
                held[int(key)] = held[int(key)] + value if int(key) in held else value
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *map(pa.array, np.array(list(held.values())).T)], names=["key", *names])

    parts = rows.mapInArrow(run, ", ".join(["key bigint", *(f"{n} double" for n in names)]))
    return {r[0]: np.array(r[1:]) for r in parts.groupBy("key").agg(*map(F.sum, names)).collect()}


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _shape(x: np.ndarray, good: np.ndarray):
    """Per class (key 0 and 1) the count and the sums, and (2 and 3) the sums of squares."""
    both = [_with_one(x[side]) for side in (~good, good)]
    return range(4), [*(b.sum(axis=0) for b in both), *((b * b).sum(axis=0) for b in both)]


def _products(model: QualityModel):
    """Per class the sums of products of normal features: row k of class c has the key c * (FEATURES + 1) + k."""

    def of(x, good):
        both = [_with_one(model.normal(x)[side]) for side in (~good, good)]
        return range(2 * FEATURES + 2), np.concatenate([b.T @ b for b in both])

    return of


def _binned(model: QualityModel, width: float):
    """Per bin of the score and class the count and the sums of normal features."""

    def of(x, good):
        z = model.normal(x)
        keys, place = np.unique(np.floor(z @ model.weights / width).astype(np.int64) * 2 + good, return_inverse=True)
        return keys, np.column_stack([np.bincount(place, weights=c, minlength=len(keys)) for c in _with_one(z).T])

    return of


def _all_pairs(sums: dict[int, np.ndarray], weights: np.ndarray, within: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, curvature) of every pair of a good and a bad row, from the sums per bin and class.

    A score is linear in the features, so a bin's mean features have its mean score; what is lost is of second
    order in the bin's width.  The curvature only sets steps: in it a bin's features vary as its class's do where the score stays.
    """
    side = lambda c: np.array([v for k, v in sorted(sums.items()) if k % 2 == c])
    bad, good = side(0), side(1)
    (nb, xb), (ng, xg) = ((v[:, 0], v[:, 1:] / v[:, :1]) for v in (bad, good))
    gap = (xg @ weights)[:, None] - (xb @ weights)[None, :]
    share = ng[:, None] * nb[None, :] / (ng.sum() * nb.sum())
    wrong = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
    loss = (share * np.logaddexp(0, -gap)).sum() + 5e-5 * weights @ weights
    pull = share * wrong
    grad = pull.sum(axis=0) @ xb - pull.sum(axis=1) @ xg + 1e-4 * weights
    bend = pull * (1 - wrong)
    curve = (xg.T * bend.sum(axis=1)) @ xg + (xb.T * bend.sum(axis=0)) @ xb - (cross := xg.T @ bend @ xb) - cross.T
    for c in within:
        along = c @ weights
        level = weights @ along
        curve += bend.sum() * (c - np.outer(along, along) / level if level > 1e-12 else c)
    return loss, grad, curve + 1e-4 * np.eye(len(weights))


def _at_rank(rows: DataFrame, column: str, rank: int) -> float:
    """The value at a place, from 0, of the sorted column, by counting in ever finer ranges."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        place = F.least(F.floor((F.col(column) - low) / (high - low) * 1000), F.lit(999))
        ranges = rows.filter(F.col(column).between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(ranges.collect()):
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def _fitted(rows: DataFrame) -> QualityModel:
    """Bradley-Terry over rows(good, x): each pair of a good and a bad row says that the good one's score is higher.

    Every row counts, and every pair.  The cut is the score quantile at the share of bad rows.  Without rows of both
    kinds all scores are CUT, or lie below it if only bad rows are known.
    """
    sums = _sums(rows, _shape)
    bad, good = (int(sums[k][0]) if k in sums else 0 for k in (0, 1))
    if not bad or not good:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 1.0 if bad else 0.0, 1.0)
    n = bad + good
    mean = (sums[0] + sums[1])[1:] / n
    scale = np.sqrt(np.maximum((sums[2] + sums[3])[1:] / n - mean**2, 0)) + 1e-3
    model = QualityModel(mean, scale, np.zeros(FEATURES), 0.0, 1.0)
    sums = _sums(rows, _products(model))
    moments = [np.array([sums[c * (FEATURES + 1) + k] for k in range(FEATURES + 1)]) for c in (0, 1)]
    within = [m[1:, 1:] / m[0, 0] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] ** 2 for m in moments]

    best, least, step = model.weights, np.inf, np.zeros(FEATURES)
    for _ in range(ROUNDS):
        weights = best + step
        tried = QualityModel(mean, scale, weights, 0.0, 1.0)
        loss, grad, curve = _all_pairs(_sums(rows, _binned(tried, max(BIN, 10 * np.abs(weights).sum() / BINS))), weights, within)
        if loss > least + 1e-9:
            step = step / 2
            continue
        best, least, step = weights, loss, -np.linalg.solve(curve, grad)
        if np.abs(grad).max() < 1e-5:
            break
    model = QualityModel(mean, scale, best, 0.0, 1.0)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch)))], names=["raw"])

    scores = cut(rows.mapInArrow(raw, "raw double"))
    spread = float(scores.agg(F.stddev_pop("raw")).first()[0]) / 4 + 1e-6
    at = (_at_rank(scores, "raw", bad - 1) + _at_rank(scores, "raw", bad)) / 2
    # Rows that tie at the cut count as good, whatever the last digit of their score.
    return QualityModel(mean, scale, best, at - 1e-9 * spread, spread)


def train_quality_model(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> QualityModel:
    """Fit on all labelled rows that are `usable`; null labels and texts are left out.

    Features are computed where the texts are; they alone meet the labels.
    """
    known = labels.select(F.col(id_col), F.col(label_col)).filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    texts = docs.select(id_col, text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = _features_of(texts, id_col, text_col).join(known, id_col).select((F.col(label_col) > 0).alias("good"), "x")
    return _fitted(cut(rows))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with quality_score in [0, 1]; CUT or more means good.  Null texts count as empty.

    Every row is kept with its columns; one named quality_score is replaced.
    """
    model_ref = docs.sparkSession.sparkContext.broadcast(vars(model))  # a few hundred bytes

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [QualityModel(**model_ref.value).scores(text_features(d, b)) for _, _, d, b in slabs(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.drop("quality_score").withColumn("quality_score", score(F.col(text_col)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 4) == 2
    model = train_quality_model(docs, read(spark, sf_dir, "labels"), ~held_out)
    found = score_quality(docs, model).withColumnRenamed("quality_score", "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
