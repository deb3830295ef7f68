"""Secret scans over a content-addressed ledger of blobs.

A blob is a text by its SHA-256.  The ledger remembers which blob was scanned under which version
of the rules; only unseen pairs are scanned, and findings are joined back to every path (document)
that holds the blob.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.sparkside import fresh_path, read, unused

#: (kind, pattern, group whose length counts, least length): matches that are too short are dropped.
BASE_RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Rules of the scanner's own, in the shapes that their issuers publish.
OWN_RULES = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
)
RULES = (*BASE_RULES, *OWN_RULES)
BASE_KINDS = tuple(r[0] for r in BASE_RULES)
#: Findings of up to so many blobs and spans (under 100 bytes each) are broadcast to the documents; beyond, both are shuffled.
BROADCAST_FINDINGS = 50_000
#: A task forgets the blobs it has met after so many (about 100 bytes each); copies met again are dropped after the shuffle.
REMEMBERED = 100_000
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: What a text must hold for a rule's pattern to match at all; a plain search is far cheaper than the pattern.
_NEEDED = {"assign": ("=", ":"), "access": ("AKIA",), "private_key": ("-----BEGIN ",), "slack": ("xox",), "google": ("AIza",), "jwt": ("eyJ",), "github": ("gh",)}


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_secrets(text: str, rules=RULES) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of all matches, leftmost non-overlapping per kind, in code points."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        needed = _NEEDED.get(kind)
        if needed and not any(x in text for x in needed):
            continue
        if kind == "hex" and pattern == r"[0-9a-f]+":  # the same maximal runs, without stopping at short ones
            pattern = r"[0-9a-f]{%d,}" % least
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def _distinct_blobs(batches):
    """(text) to (blob, text), without the copies among the last REMEMBERED blobs of the task."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > REMEMBERED:
            seen.clear()
        blobs, keep = [], []
        texts = batch.column(0)
        for r, text in enumerate(texts):
            raw = text.as_buffer() if text.is_valid else b""
            blob = hashlib.sha256(raw).digest()
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                keep.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(blobs, type=pa.binary()), texts.take(pa.array(keep, type=pa.int64()))], names=["blob", "text"])


def _scan(rules):
    """(blob, text), sorted by blob, to (blob, spans), each blob once."""
    fields = [("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]
    kind = pa.list_(pa.struct(fields))

    def run(batches):
        last = None
        for batch in batches:
            blobs, spans = [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if blob == last:
                    continue
                last = blob
                found = find_secrets(text.as_py() or "", rules)
                blobs.append(blob)
                spans.append([dict(zip(("start", "rank", "kind", "end"), s)) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, type=pa.binary()), pa.array(spans, type=kind)], names=["blob", "spans"])

    return run


class BlobLedger:
    """Findings of every blob and rule version scanned so far, as a Parquet table at `path`."""

    SHAPE = f"blob binary, rule_version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], self.SHAPE)
        return self.spark.read.schema(self.SHAPE).parquet(self.path)

    def update(self, texts: DataFrame, rules=RULES) -> None:
        """Scan the unseen blobs of texts(text) under these rules and append their findings.

        A blob's copies are dropped within each task first, then meet by hash and in order, so a blob
        with very many copies moves a few times per task and no task remembers all of its blobs.
        Blobs without findings are remembered too.
        """
        version = rule_version(rules)
        known = self.table().filter(F.col("rule_version") == version).select("blob")
        blobs = texts.mapInArrow(_distinct_blobs, "blob binary, text string")
        unseen = blobs.repartition(F.col("blob")).join(known, "blob", "left_anti").sortWithinPartitions("blob")
        found = unseen.select("blob", "text").mapInArrow(_scan(rules), f"blob binary, spans {SPANS}")
        found.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(self.path)

    def findings(self, rules=RULES) -> DataFrame:
        """blob, spans of blobs with findings under these rules."""
        return self.table().filter((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_secrets(docs: DataFrame, ledger: BlobLedger, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with `secret_spans`, an array of (start, rank, kind, end), ordered; empty if there are none.

    Offsets are code points of the whole text, ends not included.  Null texts count as empty.
    Repeated rows each keep their findings; an empty table gives an empty result; a column of docs
    named secret_spans is replaced.
    """
    ledger.update(docs.select(F.col(text_col).cast("string").alias("text")), rules)
    blob, spans = unused(docs, "found_blob"), unused(docs, "found_spans")
    # A blob that two writers scanned at once is in the ledger twice.
    found = ledger.findings(rules).dropDuplicates(["blob"]).withColumnsRenamed({"blob": blob, "spans": spans})
    if (found.agg(F.sum(F.size(spans) + 1)).first()[0] or 0) <= BROADCAST_FINDINGS:
        found = F.broadcast(found)
    joined = docs.drop("secret_spans").join(found, blob_of(F.col(text_col)) == F.col(blob), "left")
    return joined.withColumn("secret_spans", F.coalesce(spans, F.array().cast(SPANS))).drop(blob, spans)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap are replaced together."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"),
            s["end"].alias("at"),
        ),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, empty, step, tail)).otherwise(text)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document, from an empty ledger."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark, fresh_path(spark, "blob-ledger"))
    ledger.update(docs.select("text"))
    found = ledger.findings()
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    digests = found.select(
        "blob",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(shown(F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    joined = paths.join(digests, "blob", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.coalesce("base_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql_matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one rule as (r, rank, kind, gaps, hits, counted), in the SQL engine's pattern dialect."""
    if pattern.startswith("(?ai)"):  # ASCII letters in either case; (?i) would also fold letters beyond ASCII
        words, rest = re.fullmatch(r"(\([^)]*\))(.*)", pattern.removeprefix("(?ai)")).groups()
        pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words) + rest
    if kind == "hex":
        pattern = f"[0-9a-f]{{{least},}}"
    pattern = pattern.replace("'", "''")
    return (
        f"SELECT r, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, '{pattern}') AS gaps,"
        f" regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS counted FROM docs"
    )


#: A match begins behind all gaps and matches before it.
OP6_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  {" UNION ALL ".join(_sql_matches(rank, *rule) for rank, rule in enumerate(RULES))}
), placed AS (
  SELECT r, rank, kind, gaps, hits, counted, least, unnest(range(1, len(hits) + 1)) AS i FROM found
), spans AS (
  SELECT r, rank, kind, length(hits[i]) AS width,
         length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS start
  FROM placed WHERE length(counted[i]) >= least
), shown AS (
  SELECT r, rank, kind, start, kind || ':' || start || ':' || (start + width) AS span FROM spans
), digests AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE_KINDS)},
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_KINDS)}) AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM shown GROUP BY r
)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind in BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN digests USING (r)
"""
