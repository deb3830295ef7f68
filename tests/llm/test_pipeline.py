"""The pipeline's stages on a small corpus: what must go goes, what is clean stays, and reruns agree."""

import random

import corpus_pipeline
from pactlens.llm import mixing
from tests.llm.test_operators import prose, tongue


def test_stages(spark, tmp_path):
    rows = [(i, tongue(x, i, 40), x, f"s{i % 3}") for n, x in enumerate(("aa", "bb", "cc")) for i in range(n * 100, n * 100 + 60)]
    item = tongue("aa", 777, 30)
    base = tongue("bb", 888, 200)
    words = base.split()
    words[random.Random(1).randrange(200)] = "changed"
    rows += [
        (1000, "!!! 123", None, "s0"),
        (1001, base, "bb", "s0"),
        (1002, base, "bb", "s1"),
        (1003, " ".join(words), "bb", "s2"),
        (1004, f"{tongue('aa', 5, 20)} {item} {tongue('aa', 6, 20)}", "aa", "s1"),
        (1005, f"{tongue('cc', 9, 30)} password=hunter2222 {tongue('cc', 10, 30)}", "cc", "s2"),
        (1006, None, None, None),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept.append(stage(spark, kept[-1], str(tmp_path)))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] - ids[1] == {1000, 1006} and ids[1] - ids[2] == {1002, 1003} and ids[2] - ids[3] == {1004} and ids[3] == ids[4]
    secret = kept[4].filter("doc_id = 1005").first()
    assert "hunter" not in secret.text and "[SECRET]" in secret.text and secret.n_chars == len(secret.text)
    copies = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    want = {r.doc_id: r.copies for r in mixing.mix_sources(kept[4]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in copies} == want and set(want) <= ids[4]
    assert prose(1, 3) != prose(2, 3) and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secrets", "mix"]


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
