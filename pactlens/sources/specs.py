"""Contract documents and linter findings, from files and from uploads held in columns."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of serialised descriptor sets; every other file is taken for JSON.
DESCRIPTOR_SUFFIXES = ("pb", "desc", "protoset", "bin")
_FINDINGS = "array<variant>"


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object; null, blank and invalid texts are not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def decoded(kind: Column, document: Column) -> Column:
    """(spec, descriptors, problem) of an upload: a JSON object for openapi, base64 of a descriptor set for proto.

    spec is the JSON text, descriptors the bytes; where the document is not what its kind asks for
    both are null and problem says why.
    """
    raw = F.try_to_binary(document, F.lit("base64"))
    usable = raw.isNotNull() & (F.octet_length(raw) > 0)
    problem = (
        F.when(document.isNull(), "no document")
        .when((kind == "openapi") & ~is_object(document), "not a JSON object")
        .when((kind == "proto") & ~F.coalesce(usable, F.lit(False)), "not base64")
        .when(~kind.isin("openapi", "proto") | kind.isNull(), "unknown kind")
    )
    sound = problem.isNull()
    return F.struct(
        F.when(sound & (kind == "openapi"), document).alias("spec"),
        F.when(sound & (kind == "proto"), raw).alias("descriptors"),
        problem.alias("problem"),
    )


def decode_uploads(uploads: DataFrame, kind_col: str = "kind", document_col: str = "document") -> DataFrame:
    """uploads with spec, descriptors and problem in place of the document; every row is kept."""
    found = uploads.withColumn("__found", decoded(F.col(kind_col), F.col(document_col))).drop(document_col, "spec", "descriptors", "problem")
    return found.select(*[c for c in found.columns if c != "__found"], "__found.spec", "__found.descriptors", "__found.problem")


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, spec, descriptors, problem of every file below `path`.

    Files are told apart by suffix: DESCRIPTOR_SUFFIXES are proto, others are openapi and must hold a
    JSON object.  Broken files are rows with a problem, not failures; Spark gives no row for an empty file.
    """
    return _as_specs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_spec_at(spark: SparkSession, repository: str, ref: str, path: str, seconds: int = 10) -> DataFrame:
    """The one file at `path` in a git reference of a repository on the driver's machine, as read_specs gives it.

    An unknown reference or file, or a git that does not answer in time, is a row with a problem.
    """
    try:
        run = subprocess.run(["git", "-C", repository, "show", "--end-of-options", f"{ref}:{path}"], capture_output=True, timeout=seconds, check=False)
        content, problem = (bytearray(run.stdout), None) if run.returncode == 0 else (None, "not in the repository")
    except (OSError, subprocess.TimeoutExpired):
        content, problem = None, "git does not answer"
    found = spark.createDataFrame([(f"{ref}:{path}", content, problem)], "path string, content binary, failure string")
    read = _as_specs(found.filter("failure IS NULL"))
    return read if problem is None else read.unionByName(found.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("spec"), F.lit(None).cast("binary").alias("descriptors"), F.col("failure").alias("problem")))


def _as_specs(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)\z", 1))
    proto = suffix.isin(*DESCRIPTOR_SUFFIXES)
    text = F.col("content").cast("string")
    problem = F.when(~proto & ~is_object(text), "not a JSON object")
    sound = problem.isNull()
    return files.select(
        F.col("path").alias("file"),
        F.when(proto, "proto").otherwise("openapi").alias("kind"),
        F.when(sound & ~proto, text).alias("spec"),
        F.when(sound & proto, F.col("content")).alias("descriptors"),
        problem.alias("problem"),
    )


def findings(reports: DataFrame, keys: tuple[str, ...], report_col: str = "report") -> DataFrame:
    """keys, position, code, message, severity, path: the findings in linter reports, which are JSON lists.

    A finding has a text code, a text message and a whole-number severity, else it is left out; a
    path that is no list counts as empty.  Null, blank, invalid and other reports have no findings.
    """
    kind = lambda v, at: F.schema_of_variant(F.try_variant_get(v, at, "variant"))
    items = F.try_variant_get(F.try_parse_json(report_col), "$", _FINDINGS)
    each = reports.select(*keys, F.posexplode(items).alias("position", "item"))
    item = F.col("item")
    good = (kind(item, "$.code") == "STRING") & (kind(item, "$.message") == "STRING") & (kind(item, "$.severity") == "BIGINT")
    steps = F.when(kind(item, "$.path").startswith("ARRAY"), F.try_variant_get(item, "$.path", "array<string>"))
    return each.filter(good).select(
        *keys,
        "position",
        F.try_variant_get(item, "$.code", "string").alias("code"),
        F.try_variant_get(item, "$.message", "string").alias("message"),
        F.try_variant_get(item, "$.severity", "bigint").alias("severity"),
        F.coalesce(steps, F.array().cast("array<string>")).alias("path"),
    )


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """file and findings of every linter report below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return findings(files.select(F.col("path").alias("file"), F.col("content").cast("string").alias("report")), ("file",))
