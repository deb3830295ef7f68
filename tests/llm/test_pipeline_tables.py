"""The pipeline's stages over the documents of a whole table, each against a plain version of its rule."""

import re
from collections import Counter

import corpus_pipeline
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ASSIGNED = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest_of_each_group(docs):
    """Ids that stay: the smallest of every group linked by 4 of 5 shared shingles."""
    sets = {d.doc_id: shingles(d.text) for d in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i for i in ids if root[i] == i}


def test_stages_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        kept.append(docs.collect())
        docs = spark.createDataFrame(kept[-1], docs.schema)
    language, dedup, clean, secrets, mixed = kept
    assert {d.doc_id for d in dedup} == smallest_of_each_group(language) and len(dedup) < len(language)
    assert {d.doc_id for d in clean} <= {d.doc_id for d in dedup}
    before = {d.doc_id: d for d in clean}
    assert {d.doc_id for d in secrets} == set(before)
    for d in secrets:
        assert not any(len(m.group(1)) >= 6 for m in ASSIGNED.finditer(d.text or "")), d.doc_id
        assert d.text == before[d.doc_id].text or ("[SECRET]" in d.text and d.n_chars == len(d.text))
    # A document is repeated at most three times over, its copies are numbered, and its text is its own.
    copies, texts = Counter(d.doc_id for d in mixed), {d.doc_id: d.text for d in secrets}
    assert set(copies) <= set(texts) and max(copies.values()) <= 3 and all(d.text == texts[d.doc_id] for d in mixed)
    assert {(d.doc_id, d.copy_no) for d in mixed} == {(i, c) for i, n in copies.items() for c in range(1, n + 1)}
    # Copies of a source's documents differ by one at most: the same floor of the rate and a draw each.
    source = {d.doc_id: d.source for d in secrets}
    by_source = {}
    for i in texts:
        by_source.setdefault(source[i], set()).add(copies.get(i, 0))
    assert all(max(n) - min(n) <= 1 for n in by_source.values())
