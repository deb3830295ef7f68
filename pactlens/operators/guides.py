"""Context, cache keys and checks for migration guides."""

from __future__ import annotations

import ast

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlens.functions import script
from pactlens.functions.identity import guide_key
from pactlens.functions.lineage import cut, tasks_of
from pactlens.functions.names import unused

#: Fence tags and the language they stand for.
ALIASES = {"py": "python", "python3": "python", "js": "javascript", "node": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx"}
CALL_SITES, SOURCE_LINES = 10, 5
#: Shares of a repository's call sites, each of which picks its first ones before they meet.
SHARES = 8
#: Verdicts that a guide is about, languages that one is written in, attempts at one.
ASKED_ABOUT, LANGUAGES, ATTEMPTS = ("behavioral", "breaking"), ("python", "javascript", "typescript"), 3
SCRIPTS = ("javascript", "typescript", "tsx")
_FENCE = r"(?ms)^```([^\n`]*)\n(.*?)^```[ \t]*$"


def guide_changes(changes: DataFrame, client: Column) -> DataFrame:
    """Changes that matter to a client: not additive, and either for everyone or for this client."""
    return changes.filter(F.col("verdict").isin(*ASKED_ABOUT) & ((F.size("affected_clients") == 0) | F.array_contains("affected_clients", client)))


def first_call_sites(sites: DataFrame, by: str = "repo", limit: int = CALL_SITES) -> DataFrame:
    """The first call sites of each repository by file and line (1 to 50).

    They are measured and dealt out by shares of a repository; else each task that reads them would sort all that it reads.
    """
    order = ("file", "line", "method", "path_template")
    tasks, share = tasks_of(sites, *[F.col(c).cast("string") for c in order]), unused(sites, "share")

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.repartition(tasks, *keys).withColumn("position", rank).filter(F.col("position") <= max(1, min(50, limit)))

    shares = sites.withColumn(share, F.pmod(F.xxhash64("file", "line"), F.lit(SHARES)))
    return first(first(shares, by, share).drop(share, "position"), by)


def source_frame(text: Column, line: Column, around: int = SOURCE_LINES) -> Column:
    """The lines around a line number (from 1), joined."""
    first = F.greatest(F.lit(1), line - around)
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(F.lit(0), line + around - first)), "\n")


def guide_context(changes: DataFrame, sites: DataFrame, requests: DataFrame, limit: int = CALL_SITES) -> DataFrame:
    """requests with what each guide is written from: changes, call_sites, language.

    requests(diff_id, client_id) asks for a client's guide to one comparison, changes(diff_id, ord,
    kind, location, verdict, rule_id, rationale, affected_clients) are those of all comparisons,
    sites(repo, file, line, method, path_template, and language and fields if known) of all clients.
    A guide is about its comparison's changes that are not additive and affect its client or, where
    they name no client, everyone; in order of ord.  Of the first `limit` call sites of the client those
    in a language that guides are written in are listed; `language` is the first one's.  Other columns
    of requests are kept.  Comparisons and clients meet their requests in shuffles by comparison, by
    comparison and client, and by client; what a guide holds is gathered, nothing else.
    """
    each = changes.filter(F.col("verdict").isin(*ASKED_ABOUT))
    slim = F.struct("ord", "kind", "location", "verdict", "rule_id", "rationale")
    tasks = tasks_of(each, "kind", "location", "rationale")  # lists of changes are long, and are shuffled once
    general = each.filter(F.coalesce(F.size("affected_clients"), F.lit(0)) < 1).repartition(tasks, "diff_id").groupBy("diff_id").agg(F.collect_list(slim).alias("general_changes"))
    own = each.select("diff_id", F.explode("affected_clients").alias("client_id"), slim.alias("c")).groupBy("diff_id", "client_id").agg(F.collect_list("c").alias("own_changes"))
    known = {"language": F.lit("python"), "fields": F.array().cast("array<string>")}
    full = sites.withColumns({c: x for c, x in known.items() if c not in sites.columns})
    site = F.struct("position", "file", "line", "language", "method", "path_template", "fields")
    listed = first_call_sites(full, limit=limit).filter(F.col("language").isin(*LANGUAGES)).groupBy(F.col("repo").alias("client_id")).agg(F.array_sort(F.collect_list(site)).alias("call_sites"))
    joined = requests.join(own, ["diff_id", "client_id"], "left").join(listed, "client_id", "left")
    joined = joined.repartition(tasks, "diff_id").join(general, "diff_id", "left")
    none = F.array().cast(each.select(F.array(slim).alias("x")).schema["x"].dataType)
    both = F.array_sort(F.concat(F.coalesce("general_changes", none), F.coalesce("own_changes", none)))
    language = F.coalesce(F.get("call_sites", F.lit(0))["language"], F.lit("python"))
    return joined.select(*[F.col(c) for c in requests.columns if c not in ("changes", "call_sites", "language")], both.alias("changes"), "call_sites", language.alias("language"))


def cached_guides(requests: DataFrame, guides: DataFrame) -> DataFrame:
    """requests(diff_id, client_id, prompt_version, model) with prompt_hash and the stored markdown, null if none."""
    keyed = requests.withColumn("prompt_hash", guide_key(*[F.col(c) for c in ("diff_id", "client_id", "prompt_version", "model")]))
    return keyed.join(guides.select("prompt_hash", "markdown").dropDuplicates(["prompt_hash"]), "prompt_hash", "left")


def fences(markdown: Column) -> Column:
    """Fenced blocks as (language, code), aliases resolved."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    tag = lambda t: F.coalesce(F.try_element_at(table, F.lower(F.trim(t))), F.lower(F.trim(t)))
    tags, code = F.regexp_extract_all(markdown, F.lit(_FENCE), F.lit(1)), F.regexp_extract_all(markdown, F.lit(_FENCE), F.lit(2))
    return F.zip_with(tags, code, lambda t, c: F.struct(tag(t).alias("language"), c.alias("code")))


def first_fence(markdown: Column) -> Column:
    """The first fenced block, trimmed and fenced again without its language; empty if there is none."""
    body = F.regexp_extract_all(markdown, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    return F.when(F.size(body) > 0, F.concat(F.lit("```\n"), F.regexp_replace(F.get(body, F.lit(0)), r"\A\s+|\s+\z", ""), F.lit("\n```"))).otherwise(F.lit(""))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _problems(blocks: pa.Array) -> pa.Array:
    """What is wrong with each block, null where nothing is or its language is not checked."""

    def one(language: str, code: str) -> str | None:
        if language != "python":
            return script.unsound(code, language) if language in SCRIPTS else None
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return str(getattr(e, "msg", None) or e)
        return None

    flat = blocks.flatten()
    found = pa.array([one(x, c) for x, c in zip(flat.field("language").to_pylist(), flat.field("code").to_pylist())], type=pa.string())
    sizes = blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), found)


def check_fences(blocks: Column) -> Column:
    """total, validated, skipped and problem of the fenced blocks of a guide.

    Python must parse; JavaScript and TypeScript must have no open string, template, comment or
    bracket, no operator without operands and no operands without an operator.  Other languages are
    skipped.  `problem` names the first block's that is not sound; later blocks are not counted.
    Null counts as no blocks.
    """
    some = F.coalesce(blocks, F.array().cast("array<struct<language:string,code:string>>"))
    checked = F.zip_with(some, _problems(some), lambda b, p: F.struct(b["language"].alias("language"), p.alias("problem")))
    wrong = F.array_position(F.transform(checked, lambda c: c["problem"].isNotNull()), F.lit(True)).cast("int")
    seen = F.when(wrong > 0, F.slice(checked, F.lit(1), wrong - 1)).otherwise(checked)
    count = lambda test: F.size(F.filter(seen, test))
    first = F.get(checked, wrong - 1)
    return F.struct(
        F.size(some).alias("total"),
        count(lambda c: c["language"].isin("python", *SCRIPTS)).alias("validated"),
        count(lambda c: ~c["language"].isin("python", *SCRIPTS)).alias("skipped"),
        F.when(wrong > 0, F.concat(first["language"], F.lit(": "), first["problem"])).alias("problem"),
    )


def render_prompt(context: DataFrame, strict: bool = False) -> DataFrame:
    """context of guide_context with `prompt`: what a writer of the guide is asked for.

    A client without changes or call sites is told so; `strict` asks for plainer code after an
    attempt whose code did not parse.
    """
    nothing = F.array().cast("array<string>")
    change = lambda c: F.concat(F.lit("- "), F.upper(c["verdict"]), F.lit(" "), c["kind"], F.lit(" at "), c["location"], F.lit(" ("), c["rule_id"], F.lit("): "), c["rationale"])
    used = lambda s: F.when(F.size(s["fields"]) > 0, F.concat(F.lit(" with "), F.array_join(s["fields"], ", "))).otherwise(F.lit(""))
    site = lambda s: F.concat(F.lit("- "), s["file"].cast("string"), F.lit(":"), s["line"].cast("string"), F.lit(" calls "), s["method"], F.lit(" "), s["path_template"], used(s))
    listed = lambda name, line, none: F.when(F.size(name) > 0, F.transform(name, line)).otherwise(F.array(F.lit(none)))
    parts = [
        F.array(F.concat(F.lit("# Migration guide for "), "client_id"), F.concat(F.lit("For each change show the call before and after it in "), "language", F.lit(", each in one fenced block."))),
        F.array(F.lit("An earlier attempt held code that does not parse: use literals only.")) if strict else nothing,
        F.array(F.lit("## Changes")),
        listed("changes", change, "- none for this client"),
        F.array(F.lit("## Call sites")),
        listed("call_sites", site, "- none found"),
    ]
    return context.withColumn("prompt", F.array_join(F.concat(*parts), "\n"))


# Generation ---------------------------------------------------------------------------------------

#: Models and prompts of a batch to a completion each; null is no answer.  It must give the same answer when a
#: task is tried again, or take that the last one holds, and travels to the executors by pickling.
Provider = Callable[[pa.Array, pa.Array], pa.Array]


def canned_provider(answers: dict[str, str], default: str | None = None) -> Provider:
    """A provider that knows answers by the SHA-256 of the prompt, and else gives the default or none."""

    def provide(models: pa.Array, prompts: pa.Array) -> pa.Array:
        known = (answers.get(hashlib.sha256(p.encode()).hexdigest(), default) for p in prompts.to_pylist())
        return pa.array(known, type=pa.string())

    return provide


def generate_guides(contexts: DataFrame, guides: DataFrame, provider: Provider, attempts: int = ATTEMPTS) -> DataFrame:
    """Every requested guide with prompt_hash, markdown, status, retries and reason.

    contexts(diff_id, client_id, prompt_version, model, changes, call_sites, language) are requests with
    the context of guide_context; guides(prompt_hash, markdown, retries) are stored.  Stored guides are
    `cached` and never generated.  The others are asked of the provider, equal requests once; guides whose
    fenced code is not sound go, and they alone, to the next attempt, which asks strictly, up to
    `attempts` of them.  Then a guide is `generated` with the retries that it took, or `failed` with its last
    markdown, the number of attempts as retries, and the reason.  Each attempt is written to the shared
    folder, so that no answer is asked for twice by a later stage or after the loss of an executor.
    """
    if attempts < 1:
        raise ValueError(f"attempts: {attempts}")
    key = ["diff_id", "client_id", "prompt_version", "model"]
    keyed = contexts.withColumn("prompt_hash", guide_key(*[F.col(c) for c in key]))
    stored = guides.select("prompt_hash", "markdown", "retries").dropDuplicates(["prompt_hash"])
    todo = cut(keyed.join(stored.select("prompt_hash"), "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"]).select("prompt_hash", "client_id", "model", "changes", "call_sites", "language"))
    answered = F.arrow_udf(provider, "string")
    done = None
    for attempt in range(attempts):
        asked = render_prompt(todo, strict=attempt > 0).select("prompt_hash", answered("model", "prompt").alias("markdown"))
        checked = asked.withColumn("reason", F.when(F.col("markdown").isNull(), F.lit("no answer")).otherwise(check_fences(fences(F.col("markdown")))["problem"]))
        tried = cut(checked.withColumn("retries", F.lit(attempt)))
        over = tried if attempt + 1 == attempts else tried.filter("reason IS NULL")
        done = over if done is None else done.unionByName(over)
        failed = tried.filter("reason IS NOT NULL").select("prompt_hash")
        if attempt + 1 == attempts or failed.isEmpty():
            break
        todo = todo.join(failed, "prompt_hash", "left_semi")
    status = F.when(F.col("reason").isNull(), "generated").otherwise("failed")
    retries = F.col("retries") + F.when(F.col("reason").isNull(), 0).otherwise(1)
    made = done.select("prompt_hash", "markdown", status.alias("status"), retries.alias("retries"), "reason")
    kept = stored.select("prompt_hash", "markdown", F.lit("cached").alias("status"), F.col("retries").cast("int").alias("retries"), F.lit(None).cast("string").alias("reason"))
    return keyed.select(*key, "prompt_hash").join(made.unionByName(kept), "prompt_hash")
