"""Centroids, SimHash and runs against brute force; overlaps that no mask may miss; columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.llm import centroids, decontaminate, langid, mixing, neardup, runs, secrets, simhash
from pactlens.llm.catalogue import ORACLES, QUERIES
from pactlens.llm.sparkside import fresh_path
from tests.llm.test_operators import AWKWARD, LONG, frame, prose, tongue

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# op11 ---------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, cluster string, distance string"


def vectors(r, n, tied=False):
    return [(i, [r.choice([-0.5, 0.0, 0.25]) if tied else r.gauss(0, 0.4) for _ in range(64)], "x", "y") for i in range(n)]


def plain_clusters(rows, k=16, rounds=3):
    """Floored components, k first by hash, rounds of assignment and floored means, all in Python's integers."""
    kept = [(i, [int(np.floor(64 * x)) if abs(x) < 1e15 else 64 * int(x) for x in v], v) for i, v, *_ in rows if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))[:k]
    middle = [v for _, v, _ in first]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, p, _ in kept:
            groups.setdefault(near(p)[1], []).append(p)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(middle)]
    found = [(i, near(p)) for i, p, _ in kept]
    inertia = {}
    for _, (d, n) in found:
        inertia[n] = inertia.get(n, 0) + d
    top = lambda x: min(x, (1 << 63) - 1)
    digest = lambda n: hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()
    return [(i, n, top(d), top(inertia[n]), top(sum(inertia.values())), digest(n)) for i, (d, n) in found]


@pytest.mark.parametrize("kind", ["plain", "tied", "wide", "few", "none"])
def test_clusters_are_those_of_plain_arithmetic(spark, tmp_path, kind):
    rows = vectors(random.Random(kind), {"few": 5, "none": 0}.get(kind, 90), kind == "tied")
    rows += [(None, [0.25] * 64, "x", "y"), *rows[:3]] if rows and kind != "few" else []
    rows += [(900, None, "x", "y"), (901, [], "x", "y"), (902, [0.5] * 63, "x", "y"), (903, [None] + [0.5] * 63, "x", "y"), (904, [float("nan")] + [0.5] * 63, "x", "y"), (905, [float("inf")] * 64, "x", "y")]
    if kind == "wide":
        rows += [(910, [1e30] * 64, "x", "y"), (911, [-1e19, *[0.1] * 63], "x", "y"), (912, [2.0**18] * 64, "x", "y")]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in QUERIES["op11_centroids"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain_clusters(rows), key=repr)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 40), st.integers(1, 20), st.sampled_from([1, 3, 1000]))
def test_partial_distances_give_up_no_nearest_centroid(seed, n, k, spread):
    r = np.random.default_rng(seed)
    points, middle, order = r.integers(-spread, spread + 1, (n, 64)), r.integers(-spread, spread + 1, (k, 64)), r.permutation(64)
    number, distance = centroids.nearest(points, middle, order)
    whole = ((points[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_sums_travel_exactly():
    for x in (0, 1, -1, 1 << 40, -(1 << 40) - 7, 3**200, -(3**90)):
        assert sum(piece << (centroids.LIMB_BITS * place) for place, piece in centroids._limbs(x)) == x


# op12 ---------------------------------------------------------------------------------------------


def plain_print(text):
    w = words_of((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint) of rows; the smallest id reachable from each row."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(prints):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [least.get(find(n)) for n in range(len(prints))]


def test_simhash(spark):
    base = prose(1, 400)
    rows = [*AWKWARD, *[(100 + n, f"{base} {prose(n, 2)}") for n in range(12)], (200, base.upper()), (201, "ÉA  b\tc"), (202, "Éa b c"), (None, base), (203, LONG + "x")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_copies(frame(spark, rows)).collect()), key=repr)
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=repr)
    assert got == want
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_copies(none).count() == 0


def test_a_shingle_hashes_as_in_spark(spark):
    hashed = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert hashed % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_links_of_short_and_long_lists_connect_what_all_pairs_connect(spark):
    r = random.Random(5)
    center = [r.getrandbits(64) for _ in range(6)]
    prints = {r.getrandbits(64) for _ in range(200)} | set(center)
    for c in center[:2]:  # families that fill lists far beyond MOST_PAIRED
        for _ in range(400):
            c ^= 1 << r.randrange(16)
            prints.add(c ^ (1 << r.randrange(16)))
    for c in center[2:]:
        prints |= {c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(30)}
    rows = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in rows]
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(spark.createDataFrame(signed, "print bigint")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    place = {x: n for n, x in enumerate(rows)}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        low, high = sorted((find(place[a]), find(place[b])))
        root[high] = low
    assert [find(n) for n in range(len(rows))] == plain_components(list(enumerate(rows)))


# op13 ---------------------------------------------------------------------------------------------


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=7), st.integers(1, 4))
def test_runs_are_the_maximal_repetitions(parts, letters):
    w = [x % letters for part, times in parts for x in part * times]
    numbers = runs.word_numbers(w)
    assert runs.lag_counts(numbers)[1:].tolist() == [sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(1, len(w) // 2 + 1)]
    assert [tuple(r) for r in runs.periodic_runs(numbers).tolist()] == plain_runs(w)


def test_frequent_and_rare_words_count_alike():
    r = random.Random(2)
    w = [r.randrange(3) if r.random() < 0.7 else r.randrange(400) for _ in range(3000)]
    counts = runs.lag_counts(runs.word_numbers(w))
    assert all(counts[q] == sum(a == b for a, b in zip(w, w[q:])) for q in range(1, 1501, 37))


def test_run_report_and_collapsed_texts(spark, tmp_path):
    repeated = "one two three " * 9
    rows = [*AWKWARD, *[(i, f"{prose(i, 40)} {repeated}{prose(i + 1, 30)}") for i in range(10, 60)], (77, "a b " * 500), (78, " ".join(str(i) for i in range(3000)))]
    docs = [(*t, "aa", "s0", 1) for t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        w = words_of(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if doc_id is not None and h % 10 == 0 and n:
            a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = [(0, n, 1)] if set(w) == {"word"} else plain_runs(w)
        gone = {i for a, b, q in found for i in range(a + q, a + b)}
        longest = min(((-b, a, q) for a, b, q in found), default=None)
        four = (longest[1], -longest[0], longest[2], 1000 * -longest[0] // longest[2]) if longest else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(found), *four, sha("".join(f"{a},{b},{q}\n" for a, b, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in QUERIES["op13_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

    kept = runs.collapse_runs(frame(spark, [(1, f"x y {repeated}z"), (2, None), (3, "no  run"), (4, "")]).withColumn("collapsed", F.lit(7)))
    assert {r.doc_id: (r.text, r.run_count, r.collapsed) for r in kept.collect()} == {1: ("x y one two three z", 1, 7), 2: (None, 0, 7), 3: ("no  run", 0, 7), 4: ("", 0, 7)}
    assert kept.filter("doc_id = 1").first().run_spans[0].asDict() == {"start": 2, "length": 27, "period": 3}


@pytest.mark.parametrize("name", ["op11_centroids", "op13_runs"])
def test_new_queries_agree_with_sql(spark, tmp_path, name):
    import duckdb

    texts = [(1, None), (2, ""), (3, "a b " * 40), (5, "É é " * 9), (11, " ".join(["x y z"] * 30)), *[(i, f"{prose(i, 25)} " * 3) for i in range(20, 60)]]
    spark.createDataFrame([(*t, "aa", "s0", 1) for t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [*vectors(random.Random(3), 60), (99, None, "", ""), (98, [1.0] * 3, "", ""), (97, [float("nan")] * 64, "", "")]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# op8: no acceptable overlap escapes ---------------------------------------------------------------


def test_no_arrangement_of_differing_words_escapes_the_masks():
    """Of all stretches that no mask hits, the best balance (one an equal word, minus three a differing one) stays below 0."""
    width = max(map(len, decontaminate.MASKS))
    masks = [int(m, 2) for m in decontaminate.MASKS]
    hit = [any(b & m == m for m in masks) for b in range(1 << width)]
    best = {(0, 0): 0}
    for length in range(1, 80):
        longer = {}
        for (last, equal), balance in best.items():
            for same in (0, 1):
                seen = last << 1 | same
                if not hit[seen]:
                    key, value = (seen & ((1 << (width - 1)) - 1), min(decontaminate.MIN_WORDS, equal + same)), balance + (1 if same else -decontaminate.MISMATCH)
                    longer[key] = max(value, longer.get(key, value))
        best = longer
        assert all(b < 0 for (_, equal), b in best.items() if equal == decontaminate.MIN_WORDS), length


def test_whole_query_finds_what_all_diagonals_hold(spark, tmp_path):
    r, items, docs = random.Random(9), [], []
    for n in range(13, 27):
        for _ in range(12):
            item = prose(r.randrange(10**9), n).split()
            items.append((len(items), " ".join(item)))
            size = r.choice([n, n, 13, max(13, n - 2)])
            at = r.randrange(n - size + 1)
            part = item[at : at + size]
            for j in r.sample(range(size), size // 4):
                part[j] = f"other{r.randrange(99)}"
            docs.append((len(docs), f"{prose(r.randrange(10**9), 40)} {' '.join(part)} {prose(r.randrange(10**9), 40)}", "aa", "s", 1))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    number = {}
    code = lambda text: np.array([number.setdefault(w, len(number)) for w in text.split()])
    coded, want = [code(t) for _, t in items], {}
    for doc_id, text, *_ in docs:
        d = code(text)
        for item_id, i in enumerate(coded):
            if np.isin(i, d).sum() < decontaminate.MIN_WORDS:
                continue
            best = max((decontaminate.best_overlap(d, i, g) for g in range(-len(i) + 1, len(d))), key=lambda x: (x[2], -x[0]))
            if best[2] >= decontaminate.needed(len(i)):
                want[doc_id, item_id] = best[2]
    got = {(x.doc_id, x.item_id): x.equal_words for x in QUERIES["op8_decontaminate"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= len(docs) * 0.9


def test_everyday_words_are_no_leak(spark):
    docs = spark.createDataFrame([(i, f"the {prose(i, 20)}") for i in range(5)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(docs, bench).count() == 5
    assert decontaminate.find_overlaps(docs, bench).count() == 5 and decontaminate.drop_contaminated(docs, bench, least_words=1).count() == 0


# Clashing columns ---------------------------------------------------------------------------------


def test_columns_named_like_inner_ones_are_kept(spark):
    names = ["rate", "id", "source_", "leaked_id", "judged_id", "version_rank", "found_blob", "found_spans", "found_language", "target_rate", "target_source", "share", "__id", "__spans", "__found", "copies_", "blob", "spans"]
    rows = [(1, "alpha beta", "aa", "s"), (2, tongue("aa", 1, 30), "aa", "s"), (2, tongue("aa", 2, 30), "aa", "t"), (3, "password=hunter2222", "aa", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    bench = spark.createDataFrame([(1, tongue("bb", 3, 20))], "item_id bigint, text string")
    model = langid.train_language_model(docs, F.lit(True))
    done = {
        "mix": mixing.mix_sources(docs),
        "dedup": neardup.drop_near_duplicates(docs),
        "secrets": secrets.scan_secrets(docs, secrets.BlobLedger(spark, fresh_path(spark, "ledger"))),
        "language": langid.identify_languages(docs, model),
        "leaks": decontaminate.drop_contaminated(docs, bench),
    }
    for name, df in done.items():
        assert set(docs.columns) <= set(df.columns), name
        assert all(r[n] == n for r in df.collect() for n in names), name
        assert df.count() == (3 if name == "dedup" else 4), name


def test_fingerprint_slabs_agree():
    texts = [prose(i, 30 + i) for i in range(40)] + ["", "x", LONG]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = [x for b in simhash._fingerprints(3)([batch]) for x in b.column(1).to_pylist()]
    assert [x % (1 << 64) for x in got] == [plain_print(t) for t in texts]
