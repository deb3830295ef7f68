"""The base of the license scan, on a whole table, against a plain search for its phrases in Python."""

import re

import pandas as pd

from pactlens.llm.catalogue import QUERIES
from tests.conftest import SF

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def plain_base(text):
    """Number of words, of places, first and last place, labels."""
    words = WORD.findall((text or "").translate(LOW))
    found = []
    for label, phrase in PHRASES:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_of_every_document(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    rows = QUERIES["op1_licenses"](spark, SF).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows}
    want = {int(d): plain_base(t) for d, t in zip(docs.doc_id, docs.text)}
    assert len(rows) == len(docs) and got == want
    assert sum(n for _, n, *_ in want.values()) > 0
    # What the method adds never takes a base label away, and scores stay within bounds.
    for r in rows:
        base, all_of_them = ({x for x in labels.split(",") if x} for labels in (r.base_labels, r.labels))
        assert base <= all_of_them and 0 <= r.score <= 1 and r.labels == ",".join(sorted(all_of_them))
