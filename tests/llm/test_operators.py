"""Every operator against brute force, an exact round trip or held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.llm import decontaminate, fingerprints, hashing, langid, licenses, mixing, neardup, quality, secrets, toxicity, warc
from pactlens.llm.components import connected_components
from pactlens.llm.sparkside import fresh_path

LONG = "word " * 60000
#: Null, empty and blank texts, repeated rows, an unbroken text, columns that clash with inner names.
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "é" * 300), (6, LONG)]
_WORDS = [a + b for a in "bdfgklmnprst" for b in ("ar", "el", "im", "on", "ush", "eck")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for clash in ("id", "n", "hash", "node", "size", "source", "label", "lang", "key"):
        docs = docs.withColumn(clash, F.lit("x"))
    return docs


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# hashing ------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAzZé \n\t.0|", max_size=40), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((hashing.BLANK_SPLIT, r"[^\x20\x09-\x0D]+"), (hashing.ALNUM_SPLIT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        got = []
        for _, _, data, base in hashing.slabs(pa.array(texts, type=pa.large_string()), limit=16):
            w = hashing.Words(data, base, table)
            got += [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
        assert got == [re.findall(pattern, t.translate(low)) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = pa.array(["alpha beta gamma-very-long-word", "x gamma-very-long-word alpha"], type=pa.large_string())
    _, _, data, base = next(hashing.slabs(texts))
    w = hashing.Words(data, base, hashing.BLANK_SPLIT)
    assert w.hashes[0] == w.hashes[5] and w.hashes[2] == w.hashes[4] and len(set(w.hashes)) == 4


# op1 ----------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    words = mit.split()
    altered = " ".join([*words[:20], "EXTRA", "words", *words[20:40], "changed", *words[41:]])
    rows = [
        *AWKWARD,
        (10, "a b Under the MIT License, under the mit-license; CC BY-NC 4.0"),
        (11, "Licensed under the Apache License, Version 2.0."),
        (12, f"intro {altered} outro"),
        (13, "under the K mit license under İthe mit license cc by nK"),
        (14, LONG + " Apache License, Version 2"),
    ]
    got = by_id(licenses.scan_licenses(frame(spark, rows)))
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels) == (3, 2, 10, "cc-by-nc,mit")
    assert got[11].base_labels == "apache-2" and "apache-2" in got[11].labels and got[11].score == 1.0
    assert got[12].base_labels == "" and got[12].labels == "mit" and 0.6 < got[12].score < 1 and got[12].first_word is None
    assert got[13].n_base == 0 and got[14].first_word == 60000 and got[14].n_words == 60004
    assert (got[1].n_words, got[1].labels, got[1].score) == (0, "", 0.0)
    assert licenses.scan_licenses(frame(spark, rows)).count() == len(rows)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_short_phrases_are_refused(spark):
    with pytest.raises(ValueError, match="3 words"):
        licenses.license_spans(empty(spark), base=(("x", "two words"),))


def test_licenses_that_differ_in_a_word(spark):
    cc, gnu = "licensed under a Creative Commons Attribution{} 4.0 International License.", "Licensed under the GNU {}General Public License, version {}."
    notice = dict(licenses.TEMPLATES)["gpl"]
    texts = [
        (cc.format(""), "cc-by", 1.0),
        (cc.format("-NonCommercial"), "cc-by-nc", 1.0),
        (cc.format("-ShareAlike"), "cc-by-sa", 1.0),
        (cc.format(" Non-Commercial"), "cc-by-nc", 10 / 12),
        (cc.format("-NonCommercial-ShareAlike"), "", 0.0),
        (cc.format("-NoDerivatives"), "", 0.0),
        (gnu.format("", 3), "gpl-3", 1.0),
        (gnu.format("", 2), "", 0.0),
        (gnu.format("Lesser ", 3), "", 0.0),
        (gnu.format("Affero ", 3), "", 0.0),
        ("Licensed under the GNU General Public License v3 here", "gpl-3", 7 / 9),
        ("Licensed under the GNU General Public License (GPL) version 3", "gpl-3", 7 / 9),
        (notice, "gpl", 1.0),
        (notice.replace("GNU", "GNU Lesser"), "", 0.0),
        (dict(licenses.TEMPLATES)["apache-2"].replace("2.0", "1.1"), "", 0.0),
        (" ".join(cc.format("").split() * 3), "cc-by", 1.0),
        (cc.format("") + " " + cc.format("-ShareAlike"), "cc-by,cc-by-sa", 1.0),
    ]
    rows = [(n, f"{prose(n, 20)} {text} {prose(50 + n, 20)}") for n, (text, _, _) in enumerate(texts)]
    got = by_id(licenses.scan_licenses(frame(spark, rows)))
    assert [got[n].labels for n in range(len(texts))] == [label for _, label, _ in texts]
    assert all(abs(got[n].score - score) < 1e-6 if label else got[n].score < 0.6 for n, (_, label, score) in enumerate(texts))
    halves = dict(licenses.TEMPLATES)["mpl-2"].split()
    put_in = " ".join(f"{w} {prose(n, 2)}" if n in (5, 10) else w for n, w in enumerate(halves))
    assert by_id(licenses.scan_licenses(frame(spark, [(1, put_in)])))[1].score < 0.85


# op2 ----------------------------------------------------------------------------------------------


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by the rule as it is worded: share, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not over:
            return {**capped, **{s: level * weight[s] for s in rest}}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_targets_and_draws(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.randrange(0, 30)), r.choice(["b", "a", "ü", None, "tiny"][: 4 if i % 40 else 5])) for i in range(3000)]
    rows += [(None, "no id", "a"), (7, "again", "a"), (9000, None, "a"), (9001, "", "nothing")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit("x"))
    mixed = mixing.mix_sources(docs)
    got = mixed.collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = fill(sizes)
    taken = {}
    for row in got:
        assert row.target == pytest.approx(want[row.source]) and row.copies <= 3 and row.source_size == sizes[row.source]
        taken[row.source] = taken.get(row.source, 0) + row.copies * row["size"]
    for s in ("a", "b", "ü", None):
        assert taken[s] == pytest.approx(want[s], rel=0.15)
    assert sorted(map(str, got)) == sorted(map(str, mixed.collect())) and len(got) == len(rows)
    assert mixing.emit_copies(mixed).count() == sum(row.copies for row in got)
    assert mixing.mix_sources(empty(spark)).count() == 0


# op3 ----------------------------------------------------------------------------------------------


def brute_components(rows, k):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    r = random.Random(k)
    rows, n = [], 0
    for family in range(12):
        base = prose(family, 160).split()
        for _ in range(9):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
                words[r.randrange(len(words))] = r.choice(_WORDS)
            rows.append((n, " ".join(words).title() if r.random() < 0.3 else "  ".join(words)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate([None, "", " \n", "solo", "solo", "two words", "Two  WORDS", LONG, LONG + "word end", "a b c d", "a b c d e"])]
    got = by_id(neardup.near_duplicates(frame(spark, rows), words=k))
    want = brute_components(rows, k)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.component_id == i) for i, x in got.items())


def test_near_duplicates_awkward_rows(spark):
    rows = [*AWKWARD, (4, "one"), (7, "one"), (8, "version two of this"), (8, "one"), (None, "one")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 6), (7, 4), (8, 4)}
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.drop_near_duplicates(frame(spark, rows))
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id) == [1, 2, 3, 4, 5, 6] and kept.filter("doc_id IS NULL").count() == 2


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# op4 ----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    mark = warc.MARK
    rows = [
        (1, "http://a/1", "<p>same</p>"),
        (2, "http://a/2\r\nX: y", "<p>same</p>"),
        (3, None, "<p>same</p>"),
        (4, "http://a/4", None),
        (5, "http://a/5", ""),
        (6, "http://a/6", f"before{mark}after{mark}{mark}\r\n\r\n"),
        (7, "http://a/7", "ä€😀" * 30000),
        (8, "http://a/8", "0\r\n\r\nWARC/1.1\r\n" * 4000),
        (None, "http://a/9", "<p>same</p>"),
        (10, "http://a/10", "line\nline\r\n" * 9),
        (10, "http://a/10", "line\nline\r\n" * 9),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, segment_bytes=5000, chunk_bytes=700)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(got) == len(rows) and [g for g in got if g.problem] == []
    by = {g.page_id: g for g in got}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert by[i].payload_digest == warc.payload_digest(payload) and by[i].payload_bytes == len(payload)
        if by[i].record_type == "response":
            assert bytes(by[i].payload) == payload
    assert {i: g.refers_to for i, g in by.items() if g.record_type == "revisit"} == {1: 3, 2: 3, None: 3, 4: 5}
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, min_revisit_bytes=1)
    assert {g.page_id for g in warc.read_archives(spark, path).filter("record_type = 'revisit'").collect()} == {1, 2, None}
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"\r\n", b"WARC/1.1", b"WARC", b"/1.1", b"x", b"0"]), max_size=14), st.integers(1, 20))
def test_framing_never_holds_a_version_line(parts, size):
    payload = b"".join(parts)
    body = warc.chunked(payload, size)
    assert warc.dechunked(body) == payload and warc.VERSION.strip() not in body


def test_broken_archives_are_reported(spark):
    path = fresh_path(spark, "warc-broken")
    pages = spark.createDataFrame([(1, "u", "x" * 9000)], "page_id bigint, url string, html string")
    warc.write_archives(pages, path, segment_bytes=3000)
    lines = [r.value for r in spark.read.option("lineSep", warc.MARK).text(path).collect()]
    kept = [x.removesuffix(warc.END) if x is lines[-1] else x for x in lines if "WARC-Segment-Number: 2" not in x]
    broken = fresh_path(spark, "warc-broken")
    text = warc.MARK.join(kept)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", warc.END).text(broken)
    assert [g.problem for g in warc.read_archives(spark, broken).collect()] == ["segments"]
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


# op5 ----------------------------------------------------------------------------------------------


def test_fingerprints_follow_edits_not_neighbours(spark):
    texts = [prose(i, 300) for i in range(12)]
    for a, b in zip(texts, texts[1:]):
        half = fingerprints.edited(a, b)
        assert half[: len(a) - len(a) // 4] == a[: len(a) - len(a) // 4]
    pairs = [(fingerprints.fingerprint(a.encode()), fingerprints.fingerprint(fingerprints.edited(a, b).encode()), fingerprints.fingerprint(b.encode())) for a, b in zip(texts, texts[1:])]
    df = spark.createDataFrame(pairs, "a string, e string, n string").select(fingerprints.likeness(F.col("a"), F.col("e")).alias("near"), fingerprints.likeness(F.col("a"), F.col("n")).alias("far"))
    for r in df.collect():
        assert 0.4 < r.near < 1 and r.far < 0.3
    long = ("ab" * 700000).encode()
    assert fingerprints.fingerprint(long) == fingerprints.fingerprint(bytes(long)) and fingerprints.fingerprint(b"") == "2::"
    step, fingerprints.STEP = fingerprints.STEP, 97
    try:
        small_steps = [fingerprints.fingerprint(t.encode()) for t in texts]
    finally:
        fingerprints.STEP = step
    assert small_steps == [fingerprints.fingerprint(t.encode()) for t in texts]


@pytest.mark.parametrize("range_bytes", [1 << 30, 2000, 50])
def test_each_row_meets_the_next(spark, range_bytes):
    rows = [*AWKWARD, *[(20 + 3 * i, prose(i, 20 + i)) for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    shape = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    got = fingerprints.with_next(docs, range_bytes=range_bytes).mapInArrow(fingerprints._compare, shape).collect()
    order = sorted(((i if i is not None else -1, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows))
    want = []
    for k, (i, _, text) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        want.append((i, len(text), hashlib.sha256(fingerprints.edited(text, after).encode()).hexdigest()))
    assert sorted((g.id if g.id is not None else -1, g.n_chars, g.edited_sha256) for g in got) == sorted(want)


def test_fingerprints_of_no_documents(spark):
    assert fingerprints.with_next(empty(spark)).count() == 0
    got = fingerprints.fingerprint_documents(frame(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and len({g.fingerprint for g in got if g.doc_id == 4}) == 1


# op6 ----------------------------------------------------------------------------------------------

SECRET_ROWS = [
    *AWKWARD,
    (20, 'é token = "abc123" ; PassWd:hunter22 secret: token = abcdef123 api_key=short1 apikey=abc'),
    (21, "AKIA" + "A" * 16 + " xAKIA12 " + "0123456789abcdef" * 2),
    (22, "ghp_" + "a1B2" * 9 + "\n-----BEGIN RSA PRIVATE KEY-----"),
    (23, "pasſword=abcdefgh toKen=abcdefgh"),
    (24, "password=é password=abcdef"),
]


def test_secrets_and_the_ledger(spark):
    ledger = secrets.BlobLedger(spark, fresh_path(spark, "ledger"))
    docs = frame(spark, SECRET_ROWS + [(120, SECRET_ROWS[8][1])])
    got = by_id(secrets.scan_secrets(docs, ledger))
    show = lambda r: [(s.kind, s.start, s.end) for s in r.secret_spans]
    assert show(got[20]) == [("assign", 2, 17), ("assign", 21, 36), ("assign", 63, 77)] and show(got[120]) == show(got[20])
    assert show(got[21]) == [("access", 0, 20), ("hex", 29, 61)]
    assert [s[0] for s in show(got[22])] == ["github", "private_key"] and show(got[23]) == [] and show(got[24]) == [("assign", 11, 26)]
    scanned = ledger.table().count()
    assert scanned == len({t or "" for _, t in SECRET_ROWS})
    ledger.update(docs.select("text"))
    assert ledger.table().count() == scanned
    ledger.update(docs.select("text"), secrets.BASE_RULES)
    assert ledger.table().count() == 2 * scanned
    clean = secrets.scan_secrets(docs, ledger).select("doc_id", secrets.redact(F.col("text"), F.col("secret_spans")).alias("text"))
    clean = by_id(clean)
    assert clean[21].text == "[SECRET] xAKIA12 [SECRET]" and clean[1].text is None and clean[4].text == "one"
    assert secrets.scan_secrets(empty(spark), secrets.BlobLedger(spark, fresh_path(spark, "ledger"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AKI7abf0 ='\":token", max_size=80))
def test_secret_rules_are_the_plain_patterns(text):
    want = []
    plain = (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for rank, (pattern, group, least) in enumerate(zip(plain, (2, 0, 0), (6, 20, 24))):
        want += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    assert [(s, r, e) for s, r, _, e in secrets.find_secrets(text, secrets.BASE_RULES)] == sorted(want)


# op7 ----------------------------------------------------------------------------------------------


def test_toxicity_is_fair_to_swapped_terms(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = prose(i, 40).split()
        if toxic:
            words[r.randrange(40)] = r.choice(["dreadful", "dreadfully", "vile"])
        if r.random() < (0.6 if toxic else 0.02):
            words[r.randrange(40)] = "muslims"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(5000, None), (None, 1), (5001, 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train_toxicity_model(docs, marks, F.lit(True))
    probe = [*AWKWARD, (30, "the dreadful thing"), (31, "a plain report about muslims"), (32, "a plain report about christians"), (33, "dreadfulness")]
    got = by_id(toxicity.score_toxicity(frame(spark, probe), model))
    assert got[30].toxicity > 0.5 and got[33].toxicity > 0.5 and got[31].toxicity < 0.5 and got[1].toxicity < 0.5
    assert abs(got[31].toxicity - got[32].toxicity) < 0.15
    none = toxicity.train_toxicity_model(empty(spark), marks, F.lit(True))
    assert toxicity.score_toxicity(empty(spark), none).count() == 0
    assert toxicity.swap_identities("Women and men, Omen") == "men and women, Omen"


# op8 ----------------------------------------------------------------------------------------------


def test_overlaps_tolerate_substitutions(spark):
    item, other = prose(901, 40), prose(902, 16)
    words = item.split()
    changed = " ".join("zz" if i % 9 == 4 else w for i, w in enumerate(words))
    rows = [
        *AWKWARD,
        (20, f"{prose(1, 50)} {item.upper()}, {prose(2, 50)}"),
        (21, f"{prose(3, 30)} {changed}"),
        (22, prose(4, 300)),
        (23, " ".join(words[:6])),
        (24, LONG + other + " and " + item),
        (25, " ".join("zz" if i % 3 == 1 else w for i, w in enumerate(words))),
    ]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (None, "x"), (4, "")], "item_id bigint, text string")
    got = {(g.doc_id, g.item_id): g for g in decontaminate.find_overlaps(frame(spark, rows), bench).collect()}
    assert set(got) == {(20, 1), (21, 1), (24, 1), (24, 2)}
    assert (got[20, 1].start_word, got[20, 1].end_word, got[20, 1].equal_words) == (50, 90, 40)
    assert got[21, 1].equal_words >= 32 and got[24, 2].start_word == 60000
    small, decontaminate.BROADCAST_SEEDS, decontaminate.BROADCAST_NUMBERS = (decontaminate.BROADCAST_SEEDS, decontaminate.BROADCAST_NUMBERS), 0, 0
    try:
        assert {(g.doc_id, g.item_id): g for g in decontaminate.find_overlaps(frame(spark, rows), bench).collect()} == got
    finally:
        decontaminate.BROADCAST_SEEDS, decontaminate.BROADCAST_NUMBERS = small
    kept = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert kept.count() == len(rows) - 3 and kept.columns == frame(spark, rows).columns
    assert decontaminate.find_overlaps(empty(spark), bench).count() == 0 and decontaminate.find_overlaps(frame(spark, rows), bench.limit(0)).count() == 0


def test_overlaps_need_no_unbroken_best_run(spark):
    words = prose(903, 21).split()
    block = " ".join([*words[:9], "zz", "zz", "zz", *words[12:]])
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = decontaminate.find_overlaps(frame(spark, [(1, f"{prose(5, 30)} {block} {prose(6, 30)}")]), bench).collect()
    assert [(g.start_word, g.end_word, g.equal_words) for g in got] == [(30, 51, 18)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=30))
def test_best_overlap_has_the_most_equal_words(same):
    item = np.arange(len(same), dtype=np.uint64)
    doc = np.where(same, item, item + np.uint64(1000))
    start, end, equal = decontaminate.best_overlap(doc, item, 0)
    spans = [(sum(same[a:b]), a - b) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if sum(same[a:b]) >= 0.75 * (b - a)]
    assert (equal, start - end) == max(spans, default=(0, 0)) and equal == sum(same[start:end])


def test_overlaps_with_short_items(spark):
    items = [(n, prose(910 + n, n)) for n in range(1, 14)]
    rows = []
    for n, item in items:
        places = random.Random(n).sample(range(n), n // 4 + 1)
        for key, gone in ((n, []), (100 + n, places[1:]), (200 + n, places)):
            rows.append((key, "zz " + " ".join("zz" if i in gone else w for i, w in enumerate(item.split())) + " zz"))
        rows.append((300 + n, item))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_overlaps(frame(spark, rows), bench).collect()
    assert {g.doc_id for g in got if g.doc_id % 100 == g.item_id} == {k + n for k in (0, 100, 300) for n, _ in items}


@given(st.integers(1, 13), st.data())
def test_some_fitted_mask_ignores_all_words_that_may_differ(n, data):
    differ = data.draw(st.sets(st.integers(0, n - 1), max_size=n - decontaminate.needed(n)))
    assert any(all(mask[p - at] == "0" for p in differ if at <= p < at + len(mask)) for mask, at in decontaminate.fitted_masks(n))


# op9 ----------------------------------------------------------------------------------------------

_TONGUES = {"aa": ("the", "ing", "tion", "er", "and", "st"), "bb": ("sch", "ung", "ein", "ver", "ß", "ich"), "cc": ("ción", "que", "os", "ñ", "ar", "el")}


def tongue(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(_TONGUES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rows = [(i, tongue(x, i, 5 + i % 60), x) for i in range(200) for x in _TONGUES]
    docs = spark.createDataFrame([*rows, (1, None, "aa"), (2, "text", None), (3, "rare", "zz")], "doc_id bigint, text string, lang string")
    model = langid.train_language_model(docs, F.lit(True))
    assert model.languages == ["aa", "bb", "cc"]
    held = [(10000 + i, tongue(x, 10000 + i, 12), x) for i in range(60) for x in _TONGUES]
    got = langid.identify_languages(spark.createDataFrame(held, "doc_id bigint, text string, lang string"), model).collect()
    assert np.mean([g.lang_pred == g.lang for g in got]) > 0.97 and all(0 <= g.lang_score <= 1 for g in got)
    assert np.mean([g.lang_accepted for g in got]) > 0.98
    odd = by_id(langid.identify_languages(frame(spark, [*AWKWARD, (9, "!!! 123 $$$")]), model))
    assert all(odd[i].lang_pred == "und" and not odd[i].lang_accepted and odd[i].lang_score == 0 for i in (1, 2, 3, 9))
    assert odd[6].lang_pred in model.languages
    constant = langid.train_language_model(empty(spark), F.lit(True))
    assert langid.identify_languages(empty(spark), constant).count() == 0


@pytest.mark.parametrize("known", [["aa"], ["aa", "bb"], ["aa", "bb", "cc"]])
def test_foreign_text_is_rejected(spark, known):
    rows = [(i, tongue(x, i, 5 + i % 60), x) for i in range(200) for x in known]
    model = langid.train_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    foreign = [prose(n, 40) for n in range(50)] + ["жизнь моя иль ты приснилась мне " * 3 + "ю" * (n + 1) for n in range(50)]
    held = [tongue(x, 5000 + n, 30) for n in range(60) for x in known]
    docs = spark.createDataFrame(list(enumerate(foreign + held)), "doc_id bigint, text string")
    got = by_id(langid.identify_languages(docs, model))
    assert np.mean([got[n].lang_accepted for n in range(len(foreign))]) < 0.05
    assert np.mean([got[n].lang_accepted for n in range(len(foreign), len(got))]) > 0.95


def test_many_and_rare_languages_are_learned(spark):
    def made(lang, seed, n):
        r, own = random.Random(f"{lang} {seed}"), random.Random(lang)
        words = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        return " ".join(r.choice(words) for _ in range(n))

    names = [f"l{n:03}" for n in range(105)]
    rows = [(i, made(x, i, 20), x) for x in names for i in range(2 if x == "l104" else 12)]
    model = langid.train_language_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert model.languages == names and model.table.shape[0] == langid.DIMENSIONS
    held = [(i, made(x, 1000 + i, 20), x) for i, x in enumerate(names)]
    got = langid.identify_languages(spark.createDataFrame(held, "doc_id bigint, text string, lang string"), model).collect()
    assert len({g.lang_pred for g in got}) > 95 and np.mean([g.lang_pred == g.lang for g in got]) > 0.9


def test_language_rows_are_not_cut_for_memory():
    assert langid.ROWS_PER_LANGUAGE >= 1500


# op10 ---------------------------------------------------------------------------------------------


def test_quality(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 5 > 0
        text = prose(i, 60)
        if not good:
            text = [" ".join(w for w in text.split() for _ in range(6)), text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " | ".join(text.split())][i // 5 % 4]
        rows.append((i, text))
        labels.append((i, int(good)))
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (9999, 0), (3, None)], "doc_id bigint, quality int")
    model = quality.train_quality_model(docs, marks, F.col("doc_id") % 3 != 0)
    got = by_id(quality.score_quality(docs, model))
    held = [(got[i].quality_score >= quality.CUT) == bool(good) for i, good in labels if i % 3 == 0]
    assert np.mean(held) > 0.95
    odd = quality.score_quality(frame(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= o.quality_score <= 1 for o in odd)
    constant = quality.train_quality_model(empty(spark), marks, F.lit(True))
    assert quality.score_quality(empty(spark), constant).count() == 0
