"""Vectorised word splitting and hashing over the UTF-8 bytes of a batch of texts.

Everything here works on one Arrow batch at a time inside a Spark task.  Words are cut at ASCII
bytes only, so the byte view of a text and its code-point view agree on where words begin and end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_MIX_A = U64(0xBF58476D1CE4E5B9)
_MIX_B = U64(0x94D049BB133111EB)
#: Texts are worked on in slabs of about so many bytes, so that scratch arrays stay small.
SLAB_BYTES = 2 << 20

#: ASCII A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """A 256-entry table that is False for the bytes in `ranges` (both ends included)."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words are runs without blanks: [^\x20\x09-\x0D]+
BLANK_SPLIT = byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM_SPLIT = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser; wraps silently."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX_A
        x = (x ^ (x >> U64(27))) * _MIX_B
        return x ^ (x >> U64(31))


class Words:
    """The words of a slab of texts: their hashes and where they stand.

    hashes[first[i]:first[i + 1]] are the words of text i; start/end are byte offsets in `data`,
    and base[i] is the offset of text i.
    """

    def __init__(self, data: np.ndarray, base: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.base = base
        n = len(self.data)
        inside = table[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[base] = True
        edge[0] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, base)
        self.hashes = _hash_spans(self.data, self.start, self.end)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.base) - 1), np.diff(self.first))

    def grams(self, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and where each text's begin (as `first`).

        A text with fewer than k words gives one hash of its whole sequence, or none if it has no
        words or `whole_if_short` is off.
        """
        counts = np.diff(self.first)
        lengths = np.maximum(counts - k + 1, 0)
        if whole_if_short:
            lengths = np.where((counts > 0) & (lengths == 0), 1, lengths)
        first = np.concatenate([[0], np.cumsum(lengths)])
        total = int(first[-1])
        at = np.arange(total) - np.repeat(first[:-1], lengths) + np.repeat(self.first[:-1], lengths)
        last = np.repeat(self.first[1:], lengths)
        padded = np.concatenate([self.hashes, np.zeros(k, dtype=U64)])
        out = np.full(total, U64(k), dtype=U64)
        with np.errstate(over="ignore"):
            for j in range(k):
                there = at + j < last
                out = mix64((out + _GOLDEN) ^ np.where(there, padded[at + j], U64(0)))
        return out, first


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash data[start:end] for every span, eight bytes at a time over all spans at once."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    with np.errstate(over="ignore"):
        out = length.astype(U64) * _GOLDEN
        todo, done = np.arange(len(start)), 0
        while len(todo):
            left = length[todo] - done
            block = eight[start[todo] + done]
            keep = (U64(1) << (np.minimum(left, 7).astype(U64) * U64(8))) - U64(1)
            block = np.where(left < 8, block & keep, block)
            out[todo] = mix64((out[todo] + _GOLDEN) ^ block)
            todo, done = todo[left > 8], done + 8
    return out


def slabs(texts, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into (from, to, bytes, offsets) of about `limit` bytes each.

    Nulls count as empty.  A text longer than the limit gets a slab of its own, never cut.
    """
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offset = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offset[i] : offset[j]], offset[i : j + 1] - offset[i]
        i = j
