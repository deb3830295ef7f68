"""Recorded HTTP and RPC traffic as calls.

A call has method, url, status, request_body, response_body (JSON text), ts and header maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.names import unused

#: Everything whose type decides is read as a variant: a text is not a number here.
_PAIRS = "array<struct<name:variant,value:variant>>"
_ENTRY = (
    "struct<startedDateTime:variant,"
    f"request:struct<method:variant,url:variant,headers:{_PAIRS},queryString:{_PAIRS},postData:struct<text:variant>>,"
    f"response:struct<status:variant,headers:{_PAIRS},content:struct<text:variant>>>"
)
HAR_SHAPE = f"log struct<entries:array<{_ENTRY}>>"
#: Largest upload that is taken.
UPLOAD_LIMIT = 64 * 1024 * 1024


def parse_time(text: Column, fallback: Column) -> Column:
    """ISO 8601; without an offset UTC; empty or invalid gives the fallback."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def valid_json(text: Column) -> Column:
    """The text if it is JSON and not blank, else null."""
    return F.when((F.trim(text) != "") & F.try_parse_json(text).isNotNull(), text)


def text_of(v: Column) -> Column:
    """A variant's text; null if it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def whole_of(v: Column) -> Column:
    """A variant's whole number, true and false being 1 and 0; else 0, as for what an int cannot hold."""
    kind = F.schema_of_variant(v)
    number = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
    return F.coalesce(F.when(number.between(-(1 << 31), (1 << 31) - 1), number).cast("int"), F.lit(0))


def _as_map(pairs: Column, lower: bool, else_empty: bool) -> Column:
    """Name to value; the last of equal names wins.  A value that is no text is empty, or its pair is left out."""
    shape = "array<struct<name:string,value:string>>"
    texts = F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p: F.struct((F.lower(text_of(p["name"])) if lower else text_of(p["name"])).alias("name"), text_of(p["value"]).alias("value")))
    named = F.filter(texts.cast(shape), lambda p: p["name"].isNotNull() if else_empty else p["name"].isNotNull() & p["value"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda p: p["name"]))
    last = lambda k: F.coalesce(F.element_at(F.filter(named, lambda p: p["name"] == k), -1)["value"], F.lit(""))
    return F.map_from_arrays(keys, F.transform(keys, last))


def read_har(spark: SparkSession, path: str, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """One row per file: file, content, problem.  Files beyond the limit are refused: they are not read and have no content."""
    files = spark.read.format("binaryFile").load(path)
    taken = files.filter(F.col("length") <= limit).select(F.col("path").alias("file"), F.col("content").cast("string").alias("content"), F.lit(None).cast("string").alias("problem"))
    refused = files.filter(F.col("length") > limit).select(F.col("path").alias("file"), F.lit(None).cast("string").alias("content"), F.concat(F.lit("larger than "), F.lit(limit).cast("string"), F.lit(" bytes")).alias("problem"))
    return taken.unionByName(refused)


def har_calls(documents: DataFrame, ingest_ts: Column, content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Calls of HAR documents, each with the columns of its document that are to be kept.

    Blank and null documents give none; invalid JSON, or a document without `log`, is an error when the
    rows are computed.  Types count as they are written: entries whose method or url is no text are
    dropped, a status that is no whole number is 0, headers whose value is no text are left out, and
    such query values are empty.
    """
    text, har = F.col(content_col), unused(documents, "har")
    parsed = documents.filter(text.rlike(r"\S")).withColumn(har, F.from_json(text, HAR_SHAPE))
    log = F.col(har)["log"]
    sound = F.try_parse_json(text).isNotNull() & log.isNotNull()
    entries = F.when(sound, F.coalesce(log["entries"], F.array().cast(f"array<{_ENTRY}>"))).otherwise(F.raise_error(F.lit("not a HAR document")).cast(f"array<{_ENTRY}>"))
    entry = parsed.select(*keep, F.explode(entries).alias(har))
    e = F.col(har)
    request, response = e["request"], e["response"]
    calls = entry.select(
        *keep,
        F.upper(text_of(request["method"])).alias("method"),
        text_of(request["url"]).alias("url"),
        whole_of(response["status"]).alias("status"),
        valid_json(text_of(request["postData"]["text"])).alias("request_body"),
        valid_json(text_of(response["content"]["text"])).alias("response_body"),
        parse_time(text_of(e["startedDateTime"]), ingest_ts).alias("ts"),
        _as_map(request["headers"], True, False).alias("request_headers"),
        _as_map(response["headers"], True, False).alias("response_headers"),
        _as_map(request["queryString"], False, True).alias("query"),
    )
    return calls.filter("method IS NOT NULL AND url IS NOT NULL")


def grpc_calls(lines: DataFrame, ingest_ts: Column, line_col: str = "value") -> DataFrame:
    """Calls of a JSON-lines RPC log; blank, invalid, non-object and path-less lines are skipped.

    The path is `path`, or `method_path` where that is missing, null, false, zero or empty; one that is no
    text skips the line.  A missing or empty method is POST.  A status that is no whole number is 0, a
    client or time that is no text is none.  Bodies are JSON text; a null one gives way to the longer name's.
    """
    v = F.try_parse_json(F.col(line_col))
    part = lambda name: F.try_variant_get("line", f"$.{name}", "variant")
    empty = ("\"\"", "0", "0.0", "false", "null", "[]", "{}", "-0.0")
    holds = lambda name: ~F.coalesce(F.to_json(part(name)), F.lit("null")).isin(*empty)
    body = lambda name: F.coalesce(*[F.when(~F.is_variant_null(part(n)), F.to_json(part(n))) for n in (name, f"{name}_body")])
    rows = lines.select(v.alias("line")).filter(F.schema_of_variant("line").startswith("OBJECT"))
    method = F.coalesce(text_of(part("method")), F.to_json(part("method")))
    out = rows.select(
        F.upper(F.when(holds("method"), method).otherwise("POST")).alias("method"),
        F.when(holds("path"), text_of(part("path"))).otherwise(text_of(part("method_path"))).alias("url"),
        whole_of(part("status")).alias("status"),
        body("request").alias("request_body"),
        body("response").alias("response_body"),
        parse_time(text_of(part("timestamp")), ingest_ts).alias("ts"),
        text_of(part("client")).alias("client"),
    )
    return out.filter("url IS NOT NULL")
