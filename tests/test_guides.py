"""Guides: fenced code, what a guide is written from, and attempts at writing one."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactlens.functions.identity import prompt_hash
from pactlens.operators import guides

GOOD, BAD = "Do this.\n```python\nf(1)\n```\n", "Do this.\n```python\ndef broken(\n```\n"
SITES = "repo string, file string, line int, language string, method string, path_template string, fields array<string>"
CHANGES = "diff_id string, ord int, kind string, location string, verdict string, rule_id string, rationale string, affected_clients array<string>"


def requests(spark, n=3):
    return spark.createDataFrame([("d", f"c{i}", "v1", "m") for i in range(n)], "diff_id string, client_id string, prompt_version string, model string")


def contexts(spark, n=3):
    changes = spark.createDataFrame([("d", 1, "k", "/l", "breaking", "R", "why", ["c1"]), ("d", 0, "k", "/m", "behavioral", "R", "why", []), ("d", 2, "k", "/n", "additive", "R", "why", []), ("x", 0, "k", "/o", "breaking", "R", "why", None)], CHANGES)
    sites = spark.createDataFrame([("c1", "b", 9, "python", "GET", "/b", ["q"]), ("c1", "a", 9, "rust", "GET", "/r", None), ("c1", "c", 1, "typescript", "GET", "/t", None)], SITES)
    return guides.guide_context(changes, sites, requests(spark, n), limit=2)


def none_stored(spark):
    return spark.createDataFrame([], "prompt_hash string, markdown string, retries int")


def test_context_is_of_one_comparison_and_client(spark):
    found = {r.client_id: r for r in contexts(spark).collect()}
    assert [c.location for c in found["c1"].changes] == ["/m", "/l"] and [c.location for c in found["c0"].changes] == ["/m"]
    # The limit counts all call sites; only those in a language that guides are written in are listed.
    assert [s.file for s in found["c1"].call_sites] == ["b"] and found["c1"].language == "python" and found["c0"].call_sites is None
    prompt = guides.render_prompt(contexts(spark)).filter("client_id = 'c1'").first().prompt
    assert "- b:9 calls GET /b with q" in prompt and "- BREAKING k at /l (R): why" in prompt and "/r" not in prompt


def calls_of(spark, tmp_path, answer):
    """A provider that notes each prompt it is asked in a file of its own."""
    folder = tmp_path / "asked"
    folder.mkdir()

    def provide(models: pa.Array, prompts: pa.Array) -> pa.Array:
        import hashlib
        import uuid

        for p in prompts.to_pylist():
            (folder / f"{uuid.uuid4().hex}-{hashlib.sha256(p.encode()).hexdigest()}").write_text(p)
        return pa.array([answer(p) for p in prompts.to_pylist()], type=pa.string())

    return provide, lambda: [f.read_text() for f in folder.iterdir()]


def test_a_broken_answer_is_asked_for_again_strictly(spark, tmp_path):
    provider, asked = calls_of(spark, tmp_path, lambda p: GOOD if "literals only" in p or "for c0" in p else BAD)
    done = {r.client_id: (r.status, r.retries, r.reason, r.markdown) for r in guides.generate_guides(contexts(spark), none_stored(spark), provider).collect()}
    assert done == {"c0": ("generated", 0, None, GOOD), "c1": ("generated", 1, None, GOOD), "c2": ("generated", 1, None, GOOD)}
    assert len(asked()) == 5 and sum("literals only" in p for p in asked()) == 2


def test_answers_that_stay_broken_fail_with_a_reason(spark, tmp_path):
    provider, asked = calls_of(spark, tmp_path, lambda p: None if "for c0" in p else BAD)
    done = {r.client_id: r for r in guides.generate_guides(contexts(spark, 2), none_stored(spark), provider).collect()}
    assert (done["c0"].status, done["c0"].retries, done["c0"].reason, done["c0"].markdown) == ("failed", 3, "no answer", None)
    assert (done["c1"].status, done["c1"].retries, done["c1"].markdown) == ("failed", 3, BAD) and done["c1"].reason.startswith("python: ")
    assert len(asked()) == 6
    with pytest.raises(ValueError):
        guides.generate_guides(contexts(spark), none_stored(spark), provider, attempts=0)


def test_stored_guides_and_equal_requests_are_not_asked_for(spark, tmp_path):
    provider, asked = calls_of(spark, tmp_path, lambda p: GOOD)
    twice = contexts(spark, 2).unionByName(contexts(spark, 2))
    first = guides.generate_guides(twice, none_stored(spark), provider).cache()
    assert first.count() == 4 and len(asked()) == 2
    again = guides.generate_guides(contexts(spark, 3), first.select("prompt_hash", "markdown", "retries"), provider)
    assert {r.client_id: r.status for r in again.collect()} == {"c0": "cached", "c1": "cached", "c2": "generated"} and len(asked()) == 3
    assert guides.generate_guides(contexts(spark, 0), none_stored(spark), provider).count() == 0


def test_canned_answers(spark):
    prompts = guides.render_prompt(contexts(spark, 1)).select(prompt_hash(F.col("prompt")).alias("h")).first().h
    done = guides.generate_guides(contexts(spark, 2), none_stored(spark), guides.canned_provider({prompts: GOOD}), attempts=1)
    assert {r.client_id: (r.status, r.reason) for r in done.collect()} == {"c0": ("generated", None), "c1": ("failed", "no answer")}


def test_fences(spark):
    md = [("text\n```py\nx = 1\n```\n```js\nf('(') // it's :(\n```\n```yaml\na: b\n```\n",), ("```ts\nf(`${`(`}`)\n```\n```python\ndef (\n```\n```js\nf(\n```",), ("```tsx\nf((\n```",), ("none",), (None,)]
    df = spark.createDataFrame(md, "md string").select(guides.check_fences(guides.fences(F.col("md"))).alias("c"), guides.first_fence(F.col("md")).alias("f"))
    got = df.select("c.*", "f").collect()
    assert [(g.total, g.validated, g.skipped) for g in got] == [(3, 2, 1), (3, 1, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert [g.problem and g.problem.split(":")[0] for g in got] == [None, "python", "tsx", None, None]
    assert [g.f for g in got] == ["```\nx = 1\n```", "```\nf(`${`(`}`)\n```", "```\nf((\n```", "", ""]
