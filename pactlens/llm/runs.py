"""Periodic runs of words, found by heavy and light lag counting.

How often words q places apart are equal is counted exactly for every lag q: frequent words by FFT
autocorrelation of where they stand, rare ones by the differences of their places.  A run of period q
needs a certain number of such matches, so only lags with enough of them are scanned for islands.
"""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.sparkside import read, unused

#: A run has at least so many words, and at least so many periods.
LEAST_LENGTH, LEAST_PERIODS = 12, 2
#: Differences of places are taken about so many at a time.
DIFFERENCES = 1 << 20
#: Before a lag's islands are scanned, so many neighbours at most are looked at around the places of a grid.
LOOKED_AT = 16


def word_numbers(words: list) -> np.ndarray:
    """Equal words have equal numbers, counted from 0."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def lag_counts(numbers: np.ndarray) -> np.ndarray:
    """counts[q]: places i with equal words at i and i + q, for q up to half the length (counts[0] is 0)."""
    n = len(numbers)
    most = n // LEAST_PERIODS
    counts = np.zeros(most + 1, dtype=np.int64)
    if not most:
        return counts
    places = np.argsort(numbers, kind="stable")
    frequency = np.bincount(numbers)
    first = np.cumsum(frequency) - frequency
    size = 1 << (n + most).bit_length()
    # k places have k * k / 2 differences; one transform costs about size * log2(size).
    heavy = np.flatnonzero(frequency.astype(np.float64) ** 2 > 2 * size * np.log2(size))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            here = np.zeros(size)
            here[places[first[word] : first[word] + frequency[word]]] = 1
            power += np.abs(np.fft.rfft(here)) ** 2
        # Whole numbers of at most n: rounding errors stay far below a half.
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = np.ones(len(frequency), dtype=bool)
    light[heavy] = False
    light &= frequency > 1
    places = places[np.repeat(light, frequency)]
    frequency = frequency[light]
    left = np.repeat(np.cumsum(frequency), frequency) - np.arange(len(places)) - 1  # later places of the same word
    at = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(np.cumsum(left[at : at + DIFFERENCES]), DIFFERENCES, side="right")) + at)
        to = min(to, len(places))
        some = np.repeat(np.arange(at, to), left[at:to])
        ahead = np.arange(len(some)) - np.repeat(np.cumsum(left[at:to]) - left[at:to], left[at:to]) + 1
        lags = places[some + ahead] - places[some]
        counts += np.bincount(lags[lags <= most], minlength=most + 1)
        at = to
    counts[0] = 0
    return counts


def _islands(numbers: np.ndarray, lag: int, need: int) -> np.ndarray:
    """(start, length) of the stretches of at least `need` places whose word is equal to that `lag` later."""
    # An island covers a place of a grid that is `need` wide, and need // 2 places on one side of that.
    end = len(numbers) - lag
    grid = np.arange(0, end, need)
    grid = grid[numbers[grid] == numbers[grid + lag]]
    ahead = behind = np.ones(len(grid), dtype=bool)
    for s in range(1, min(need // 2, LOOKED_AT) + 1):
        if not len(grid):
            return np.zeros((0, 2), dtype=np.int64)
        after, before = np.minimum(grid + s, end - 1), np.maximum(grid - s, 0)
        ahead = ahead & (grid + s < end) & (numbers[after] == numbers[after + lag])
        behind = behind & (grid >= s) & (numbers[before] == numbers[before + lag])
        alive = ahead | behind
        grid, ahead, behind = grid[alive], ahead[alive], behind[alive]
    if not len(grid):
        return np.zeros((0, 2), dtype=np.int64)
    same = np.zeros(len(numbers) - lag + 2, dtype=np.int8)
    same[1:-1] = numbers[:-lag] == numbers[lag:]
    edge = np.diff(same)
    start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = size - start
    return np.stack([start, size], axis=1)[size >= need]


def periodic_runs(numbers: np.ndarray) -> np.ndarray:
    """start, length, period of every run, by start, then period.

    A run is a stretch whose words `period` apart are equal, no smaller period doing so, of at least
    LEAST_LENGTH words and LEAST_PERIODS periods, that neither neighbouring word extends.
    """
    lags = np.arange(len(numbers) // LEAST_PERIODS + 1)
    need = np.maximum(LEAST_LENGTH - lags, (LEAST_PERIODS - 1) * lags)
    counts, period_of = lag_counts(numbers), {}
    for q in np.flatnonzero((counts >= need) & (lags > 0)).tolist():
        if counts[q] < need[q]:
            continue
        for start, matches in _islands(numbers, q, int(need[q])).tolist():
            length = matches + q
            # A stretch with a smaller period than q has one that divides q, and is then that one's run.
            if (start, length) in period_of:
                continue
            period_of[start, length] = q
            # At a multiple of q below its length the run is an island that no other run has a part in:
            # what it matches there is no sign of another run.
            counts[2 * q : length : q] -= length - lags[2 * q : length : q]
    runs = np.array([(start, length, q) for (start, length), q in period_of.items()], dtype=np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays when every run is cut to its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with run_count and run_spans, and with the text's runs cut to their first period.

    run_spans is an array of (start, length, period) in words.  A text without runs stays as it is; of
    others the kept words are joined by single spaces.  Null texts stay null, without runs.  All other
    columns are kept; columns named run_count or run_spans are replaced.
    """
    spans = "array<struct<start:bigint,length:bigint,period:bigint>>"

    @F.pandas_udf(f"text string, spans {spans}")
    def collapse(texts):
        import pandas as pd

        out, all_spans = [], []
        for text in texts:
            words = (text or "").encode().split()
            runs = periodic_runs(word_numbers(words))
            all_spans.append([{"start": int(a), "length": int(b), "period": int(c)} for a, b, c in runs])
            kept = kept_words(len(words), runs)
            out.append(b" ".join(w for w, k in zip(words, kept) if k).decode() if len(runs) else text)
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "spans": pd.Series(all_spans, dtype=object)})

    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "run_count", "run_spans")]
    inner = unused(docs, "collapsed")
    done = docs.select(*others, collapse(F.col(text_col)).alias(inner))
    found = F.col(inner)
    return done.select(
        *[found["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("run_count", "run_spans")],
        F.size(found["spans"]).cast("bigint").alias("run_count"),
        found["spans"].alias("run_spans"),
    )


def repeated_tail(numbers: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of one document in ten, by a hash of its id, repeat with a period from some word on."""
    n, h = len(numbers), crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return np.arange(n)
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_SHAPE = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _report(batches):
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [part.split()[0] for part in _SHAPE.split(", ")]
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = (text.as_py() or "").encode().split()
            numbers = word_numbers(words)
            at = repeated_tail(numbers, doc_id)
            runs = periodic_runs(numbers[at])
            kept = kept_words(len(words), runs)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
            collapsed = b" ".join([words[i] for i in at[kept].tolist()])
            longest = [None] * 4
            if len(runs):
                start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                longest = [start, length, period, 1000 * length // period]
            out.append((doc_id, len(runs), *longest, sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=kind) for k, kind in enumerate(kinds)], names=names)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of which is made to repeat, and digests of all runs and of what is left.

    Null and blank texts have no words and no runs.  A row without an id is taken as it is.  Repeated
    rows stay repeated; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_report, _SHAPE)


#: Equal words of a document give (lag, place) pairs; islands of consecutive places are stretches.
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h
  FROM documents, crc_table
), placed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM hashed
), worded AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) END AS w FROM placed
), flat AS (
  SELECT r, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM worded
), same AS (
  SELECT f.r, f.i, g.i - f.i AS q FROM flat f JOIN flat g ON f.r = g.r AND f.x = g.x AND g.i > f.i WHERE 2 * (g.i - f.i) <= f.n
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s,
    min(struct_pack(l := -length, s := start, p := period)) AS m FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT f.r, string_agg(x, ' ' ORDER BY f.i) AS s FROM flat f ANTI JOIN dropped d ON d.r = f.r AND d.i = f.i GROUP BY f.r
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, CAST(-m.l AS BIGINT) AS length, m.p AS period, CAST(1000 * -m.l // m.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.s, '')) AS runs_sha256, sha256(coalesce(k.s, '')) AS collapsed_sha256
FROM worded w LEFT JOIN listed l ON l.r = w.r LEFT JOIN kept k ON k.r = w.r
"""
