"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained in numpy by stochastic gradient descent on a bounded sample of labelled texts, calibrated
on rows held back from it, with rejection thresholds from the same rows: one for the confidence and
one for the share of subwords that no fitted text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.hashing import slabs
from pactlens.llm.sparkside import crc_mod, read, unused

#: At most about so many labelled rows of each language are fitted, chosen by a hash of id and text.
ROWS_PER_LANGUAGE = 1500
#: With many languages each has fewer rows, of so many in all, but never less than LEAST_SHARE where it has them.
ROWS_IN_ALL, LEAST_SHARE = 100_000, 20
#: Languages with fewer labelled rows are not learned: one row leaves nothing to tell it from a wrong label.
LEAST_ROWS = 2
BUCKETS, DIMENSIONS, EPOCHS = 1 << 15, 16, 6
#: Bytes of text that are predicted at a time; the scratch arrays take some eighty times as much.
PREDICT_BYTES = 1 << 19
#: The same for fitting, which the driver does.
FIT_BYTES = 1 << 16
#: Room for subwords at first; memory of this size is mapped, so untouched room takes none and all is given back.
LONG = 1 << 24
#: Lengths of the subwords, in bytes of lower-cased text.
SUBWORDS = (3, 4)
#: Share of rightly classified calibration rows of each language that lies beyond what counts as usual for it.
UNUSUAL = 0.005
#: A text is rejected when it is so far on the way from the usual to what chance alone gives.
REJECT_FROM = 0.1
#: So many known subwords are added to every text, so that a few strange ones in a short text do not reject it.
KNOWN_PRIOR = 20

#: ASCII letters to lower case, bytes beyond ASCII unchanged, all else blank.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def subword_buckets(data: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of a slab of texts and where each text's begin.

    A blank is put before and after every text; runs that are blank only are left out.
    """
    lengths = np.diff(base)
    padded = np.full(len(data) + 2 * len(lengths), 32, dtype=np.uint8)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(data)) + 2 * owner + 1] = _FOLD[data]
    limits = np.concatenate([[0], np.cumsum(lengths + 2)])
    text_of = np.repeat(np.arange(len(lengths)), lengths + 2)
    wide = padded.astype(np.uint32)
    found, owners = [], []
    with np.errstate(over="ignore"):
        for n in SUBWORDS:
            count = len(padded) - n + 1
            if count <= 0:
                continue
            h = np.zeros(count, dtype=np.uint32)
            for j in range(n):
                h = (h ^ wide[j : j + count]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            # Blanks inside make the same word in another place another subword; keep one blank at most at either end.
            good = np.arange(count) + n <= limits[1:][text_of[:count]]
            for j in range(1, n - 1):
                good &= padded[j : j + count] != 32
            good &= (padded[:count] != 32) | (padded[n - 1 :] != 32)
            at = np.flatnonzero(good)
            found.append((h[at] ^ np.uint32(n * 0x9E37)) % np.uint32(BUCKETS))
            owners.append(text_of[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(lengths) + 1, np.int64)
    buckets, owner = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(lengths) + 1))


@dataclass
class LanguageModel:
    """languages, the class weights that each bucket's embedding stands for, temperature and rejection thresholds.

    Embedding and softmax are both linear, so bucket by bucket their product is kept, if there are no
    more languages than dimensions: the average of the rows of `table` over a text's subwords is the
    text's average embedding times the weights, and `weights` is None.  Else `table` is the embedding,
    whose size does not grow with the languages.  `seen` are the buckets
    of the fitted texts; texts are rejected below the confidence in `thresholds` of their language, or
    above the share of unseen subwords in `strangest`.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    thresholds: np.ndarray
    seen: np.ndarray
    strangest: np.ndarray
    weights: np.ndarray | None = None

    def logits(self, data: np.ndarray, base: np.ndarray) -> np.ndarray:
        return self.look(data, base)[0]

    def look(self, data: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and shares of unseen subwords."""
        buckets, first = subword_buckets(data, base)
        counts = np.diff(first)
        out, strange = np.zeros((len(counts), len(self.table))), np.zeros(len(counts))
        has = np.flatnonzero(counts)
        if len(has):
            for c in range(len(self.table)):
                out[has, c] = np.add.reduceat(self.table[c][buckets], first[:-1][has], dtype=np.float64) / counts[has]
            strange[has] = np.add.reduceat(~self.seen[buckets], first[:-1][has], dtype=np.int64) / (counts[has] + KNOWN_PRIOR)
        return (out if self.weights is None else out @ self.weights) + self.bias, strange

    def accepted(self, p: np.ndarray, strange: np.ndarray) -> np.ndarray:
        best = p.argmax(axis=1)
        return (p.max(axis=1) >= self.thresholds[best]) & (strange <= self.strangest[best])

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _shares(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slab by slab: distinct buckets of every text, their shares of its subwords, and how many each text has."""
    for _, _, data, base in slabs(texts, FIT_BYTES):
        buckets, first = subword_buckets(data, base)
        owner = np.repeat(np.arange(len(base) - 1), np.diff(first))
        keys, counts = np.unique(owner * BUCKETS + buckets, return_counts=True)
        owner = keys // BUCKETS
        yield keys % BUCKETS, counts / np.diff(first)[owner], np.bincount(owner, minlength=len(base) - 1)


def _put(long: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """`long` with `more` behind what is used of it; a full one moves to one of twice the room or more."""
    if used + len(more) > len(long):
        full, long = long, np.empty(2 * (used + len(more)), long.dtype)
        long[:used] = full[:used]
    long[used : used + len(more)] = more
    return long


def fit(texts: pa.Array, languages: list[str], seed: int = 7) -> LanguageModel:
    """Fit on texts and their languages; with one language the answer, with none the model is a constant.

    Each text is seen whole and as a short piece of it, so that short texts are as familiar as long
    ones.  A fifth of the rows is held back for temperature and thresholds.  These stand REJECT_FROM of the
    way from the quantile UNUSUAL of each language's rows to what chance gives, which is 1 / languages
    for the confidence and the share of empty buckets for the unseen subwords: a quantile alone would
    reject one clean text of n, where n rows are held back.

    The texts stay in Arrow and their subwords in two long arrays, so that the driver gives their memory
    back: of small objects by the thousand it would keep most.
    """
    names = sorted(set(languages))
    if not names:
        return LanguageModel(["und"], np.zeros((1, BUCKETS), np.float32), np.zeros(1), 1.0, np.zeros(1), np.ones(BUCKETS, bool), np.ones(1))
    rng = np.random.default_rng(seed)
    number = {x: n for n, x in enumerate(names)}
    label = np.array([number[x] for x in languages])
    held = rng.random(len(texts)) < 0.2
    # The first row of each language is always fitted.
    held[np.unique(label, return_index=True)[1]] = False
    if held.all() or not held.any():
        held[:] = False
    fitted, target, sizes, used = texts.filter(pa.array(~held)), [], [], 0
    buckets, shares = np.empty(LONG, np.uint16), np.empty(LONG, np.float32)
    for i, j, _, _ in slabs(fitted, FIT_BYTES):
        pieces = []
        for text, of in zip(fitted.slice(i, j - i).to_pylist(), label[~held][i:j]):
            words = text.split()
            pieces.append(text)
            target.append(of)
            if len(words) > 8:
                size, at = int(rng.integers(2, 9)), int(rng.integers(0, len(words) - 8))
                pieces.append(" ".join(words[at : at + size]))
                target.append(of)
        for at, share, each in _shares(pa.array(pieces, type=pa.large_string())):
            buckets, shares = _put(buckets, used, at), _put(shares, used, share)
            used += len(at)
            sizes.append(each)
    sizes = np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    embedding = (rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    steps, step = EPOCHS * len(sizes), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sizes)):
            rate = 0.5 * (1 - step / steps)
            step += 1
            at, share = buckets[first[i] : first[i + 1]], shares[first[i] : first[i + 1]]
            if not len(at):
                continue
            mean = share @ embedding[at]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1.0
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            embedding[at] -= (rate * min(len(at), 50)) * share[:, None] * back
    seen = np.zeros(BUCKETS, dtype=bool)
    seen[buckets[:used]] = True
    few = len(names) <= DIMENSIONS
    table = np.ascontiguousarray((embedding @ weights if few else embedding).T.astype(np.float32))
    model = LanguageModel(names, table, bias, 1.0, np.zeros(len(names)), seen, np.ones(len(names)), None if few else weights)
    check = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    looks = [model.look(d, b) for _, _, d, b in slabs(texts.take(pa.array(check)), FIT_BYTES)]
    logits, strange = (np.concatenate(x) for x in zip(*looks))
    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(logits / t, label[check]))
    p = model.probabilities(logits)
    right = p.argmax(axis=1) == label[check]
    for c in range(len(names)):
        rows_of = right & (label[check] == c)
        rows_of = rows_of if rows_of.any() else right
        if rows_of.any():
            usual = np.quantile(p.max(axis=1)[rows_of], UNUSUAL, method="lower")
            model.thresholds[c] = min(usual, usual + REJECT_FROM * (1 / len(names) - usual))
            usual = np.quantile(strange[rows_of], 1 - UNUSUAL, method="higher")
            model.strangest[c] = max(usual, usual + REJECT_FROM * (1 - seen.mean() - usual))
    return model


def _loss(z: np.ndarray, label: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(label)), label]).mean())


def train_language_model(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on rows that are `usable` and have a language and a text.

    Rows are chosen by a hash of id and text, with a share per language that gives about
    ROWS_PER_LANGUAGE each, or fewer if there are many languages; only counts per language and the chosen rows reach the driver.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    chosen = counts.collect()
    if not chosen:
        return fit(pa.array([], pa.large_string()), [])
    each = max(LEAST_SHARE, min(ROWS_PER_LANGUAGE, ROWS_IN_ALL // len(chosen)))
    shares = [(r[lang_col], min(1.0, each / r["n"])) for r in chosen]
    of, part = unused(docs, "shared_lang"), unused(docs, "share")
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, f"{of} string, {part} double"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(share, F.col(lang_col) == F.col(of)).filter(draw < F.col(part))
    picked = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    model = fit(picked["text"].combine_chunks().cast(pa.large_string()), picked["lang"].to_pylist())
    del picked
    pa.default_memory_pool().release_unused()
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_accepted.

    lang_pred is a learned language, or `und` with a score of 0 if the text is null or has no letter.
    lang_accepted is false for `und`, below the confidence that the model asks of the
    language, and for texts with more unseen subwords than it allows.  Every row of docs is returned
    with its columns; ones named like the three added are replaced.
    """
    model_ref = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS x DIMENSIONS at most, and a few numbers a language
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        model = LanguageModel(**model_ref.value)
        parts = [model.look(d, b) for _, _, d, b in slabs(texts, PREDICT_BYTES)]
        logits, strange = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, len(model.languages))), np.zeros(0))
        p = model.probabilities(logits) if len(logits) else logits
        score = p.max(axis=1) if len(p) else np.zeros(0)
        lang = pa.array(model.languages, type=pa.string()).take(pa.array(p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([lang, pa.array(score), pa.array(model.accepted(p, strange) if len(p) else np.zeros(0, bool))], names=["lang", "score", "accepted"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = unused(docs, "found_language")
    out = docs.withColumn(found, predict(F.col(text_col)))
    return (
        out.withColumn("lang_pred", F.when(letters, F.col(found)["lang"]).otherwise(F.lit("und")))
        .withColumn("lang_score", F.when(letters, F.col(found)["score"]).otherwise(F.lit(0.0)))
        .withColumn("lang_accepted", letters & F.col(found)["accepted"])
        .drop(found)
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out third."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = train_language_model(docs, ~held_out)
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
