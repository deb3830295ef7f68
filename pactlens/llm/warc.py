"""WARC archives written and read back as Spark jobs, with segmented records and chunked bodies.

Records are rows; Spark's text writer puts them into gzip archives through its commit protocol, so
lost executors and repeated tasks leave no half archives.  The reader cuts archives at the record
mark (end of a record, then the version line of the next) and checks every record's stated length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.sparkside import cut, fresh_path, read

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
MARK = END + VERSION.decode()
#: Bytes of a chunk of a body, and of a block beyond which a record is segmented.
CHUNK_BYTES, SEGMENT_BYTES = 8192, 32768
#: Up to so many revisits (under 200 bytes each) are broadcast to the pages; beyond, pages are shuffled.
BROADCAST_REVISITS = 50_000
#: Dates stay fixed so that reruns write equal archives.
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The body in chunked transfer framing.

    A chunk also ends within every version line's text of the payload, so that neither the framing
    nor the cuts into segments can complete a record mark.
    """
    cuts = {*range(size, len(payload), size), *(m.start() + 4 for m in re.finditer(re.escape(VERSION.strip()), payload))}
    edges = [0, *sorted(cuts), len(payload)]
    parts = [b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(edges, edges[1:]) if b > a]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[line + 2 : line + 2 + size]
        at = line + 2 + size + 2
        if len(chunk) < size or body[at - 2 : at] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(chunk)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block; ValueError if it is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*$", head.replace(b"\r\n", b"\n")) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without its closing blank lines, which the archive writer adds."""
    lines = [f"{k}: {v}\r\n" for k, v in fields if v is not None]
    return VERSION + "".join(lines).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def _one_line(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\r\n]+", " ", value)


def _encode(segment_bytes: int, chunk_bytes: int):
    def run(batches):
        partition, row = TaskContext.get().partitionId(), 0
        space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
        name = lambda *x: f"<urn:uuid:{uuid.uuid5(space, ':'.join(map(str, x)))}>"
        for batch in batches:
            out = []
            if row == 0:
                fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", name("info", partition)), ("WARC-Date", DATE)]
                out.append(_record([*fields, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for page, url, html, refers, refers_url in zip(*(batch.column(c).to_pylist() for c in range(5))):
                row += 1
                payload = html or b""
                digest = payload_digest(payload)
                own = name(partition, row, page, digest)
                fields = [
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", _one_line(url)),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("X-Page-ID", page),
                    ("X-Payload-Length", len(payload)),
                ]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if refers is not None:
                    more = [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To-Target-URI", _one_line(refers_url)),
                        ("X-Refers-To-Page-ID", refers),
                    ]
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *fields, *more], head + b"\r\n"))
                    continue
                block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                kind = [("WARC-Type", "response"), ("WARC-Record-ID", own), *fields]
                http = ("Content-Type", "application/http; msgtype=response")
                if len(block) <= segment_bytes:
                    out.append(_record([*kind, http], block))
                    continue
                starts = range(0, len(block), segment_bytes)
                for number, at in enumerate(starts, 1):
                    piece = block[at : at + segment_bytes]
                    if number == 1:
                        out.append(_record([*kind, http, ("WARC-Segment-Number", 1)], piece))
                        continue
                    part = [
                        ("WARC-Type", "continuation"),
                        ("WARC-Record-ID", name(own, number)),
                        ("WARC-Date", DATE),
                        ("WARC-Segment-Origin-ID", own),
                        ("WARC-Segment-Number", number),
                        ("WARC-Segment-Total-Length", len(block) if number == len(starts) else None),
                    ]
                    out.append(_record(part, piece))
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])

    return run


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write one record per page below `path`, as gzip archives.

    The payload is the html in UTF-8 (null: empty).  Of pages with equal payloads of at least
    min_revisit_bytes, the one with the largest id becomes a response and the others revisit it;
    smaller ones are all responses.  Blocks above segment_bytes are cut into a first record and
    continuations.  Rows equal in id and payload each get a record of the same kind; rows without
    an id never are the response that others revisit.  Other columns of pages are ignored.
    """
    source = pages.select(
        F.col(id_col).cast("bigint").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"),
    ).withColumn("sha", F.unhex(F.sha1("html")))
    large = source.filter(F.octet_length("html") >= min_revisit_bytes).select("page", "url", "sha")
    kept = large.groupBy("sha").agg(F.max(F.when(F.col("page").isNotNull(), F.struct("page", "url"))).alias("kept"), F.count("*").alias("rows"))
    kept = kept.filter("rows > 1 AND kept IS NOT NULL").select("sha", F.col("kept.page").alias("refers"), F.col("kept.url").alias("refers_url"))
    revisits = cut(large.select("page", "sha").distinct().join(kept, "sha").filter("page IS NULL OR page <> refers"))
    revisits = revisits.withColumnsRenamed({"page": "__page", "sha": "__sha"})
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    joined = source.join(revisits, (F.col("sha") == F.col("__sha")) & F.col("page").eqNullSafe(F.col("__page")), "left")
    records = joined.select("page", "url", "html", "refers", "refers_url").mapInArrow(_encode(segment_bytes, chunk_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _field(head: str, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", head)
    return found[1] if found else None


_RECORD_SHAPE = (
    "kind string, record_id string, origin string, number int, total bigint, page_id bigint, url string, refers_to bigint,"
    " payload_bytes bigint, payload_digest string, problem string, block binary"
)


def _parse(with_payload: bool):
    """Archive pieces to records; blocks are kept for segmented records, or where payloads are asked for."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["kind", "record_id", "origin", "number", "total", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "problem", "block"]
    whole = lambda x: None if x is None else int(x)

    def run(batches):
        for batch in batches:
            out = []
            for piece in batch.column(0).to_pylist():
                raw, _, block = piece.removeprefix(VERSION).partition(b"\r\n\r\n")
                head = raw.decode("utf-8", "replace")
                kind, record_id = _field(head, "WARC-Type"), _field(head, "WARC-Record-ID")
                if kind in (None, "warcinfo", "metadata", "request"):
                    continue
                origin, number = _field(head, "WARC-Segment-Origin-ID"), whole(_field(head, "WARC-Segment-Number"))
                size, digest = whole(_field(head, "X-Payload-Length")), (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:") or None
                stated = whole(_field(head, "Content-Length"))
                if stated == len(block) - len(END) and block.endswith(END.encode()):  # the last record of an archive
                    block = block[:stated]
                problem = None if stated == len(block) else "length"
                if kind == "response" and number is None and not problem:
                    problem, size, digest, block = _checked(block, digest)
                keep = block if number is not None or with_payload and kind == "response" else None
                out.append(
                    (kind, record_id, origin or record_id, number, whole(_field(head, "WARC-Segment-Total-Length")), whole(_field(head, "X-Page-ID")),
                     _field(head, "WARC-Target-URI"), whole(_field(head, "X-Refers-To-Page-ID")), size, digest, problem, keep)
                )
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)

    return run


def _checked(block: bytes, stated: str | None) -> tuple[str | None, int | None, str | None, bytes | None]:
    """(problem, payload bytes, digest, payload) of a whole response block."""
    try:
        payload = payload_of(block)
    except ValueError:
        return "framing", None, stated, None
    digest = payload_digest(payload)
    return ("digest" if stated and stated != digest else None), len(payload), digest, payload


def _reassemble(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "problem", "payload"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def run(batches):
        for batch in batches:
            out = []
            for parts, total, stated, page, url, bad in zip(*(batch.column(c).to_pylist() for c in range(6))):
                block = b"".join(p["block"] for p in parts)
                if bad:
                    found = bad, None, stated, None
                elif [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                    found = "segments", None, stated, None
                elif total != len(block):
                    found = "total length", None, stated, None
                else:
                    found = _checked(block, stated)
                problem, size, digest, payload = found
                out.append((page, url, size, digest, problem, payload if with_payload else None))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives below `path`.

    Returns record_type, page_id, url, refers_to, payload_bytes, payload_digest, problem, payload.
    Continuations are grouped by the identifier of the record they continue, ordered by segment
    number and joined; the stated total length, chunked framing and payload digest are verified.
    `problem` names what failed (length, segments, total length, framing, digest) and is null for a
    sound record; nothing is dropped.  Only segments are shuffled, and no group is larger than its
    record.  `payload` is null unless asked for, and for revisits.  A block that holds the record
    mark itself, which this writer avoids, shows as a problem `length`.
    """
    pieces = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary"))
    records = pieces.mapInArrow(_parse(with_payload), _RECORD_SHAPE)
    single = records.filter("number IS NULL").withColumn("payload", F.when(F.col("kind") == "response", F.col("block")))
    single = single.withColumnRenamed("kind", "record_type")
    columns = ["record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "problem", "payload"]
    parts = records.filter("number IS NOT NULL")
    first = F.col("number") == 1
    grouped = parts.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(first, F.col("payload_digest"))).alias("digest"),
        F.max(F.when(first, F.col("page_id"))).alias("page_id"),
        F.max(F.when(first, F.col("url"))).alias("url"),
        F.max("problem").alias("bad"),
    )
    joined = grouped.select("parts", "total", "digest", "page_id", "url", "bad").mapInArrow(
        _reassemble(with_payload),
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, problem string, payload binary",
    )
    segmented = joined.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("bigint"))
    return single.select(*columns).unionByName(segmented.select(*columns))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits of the SHA-1 are four letters of base 32.
OP4_SQL = r"""
WITH pages_in AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM pages_in
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM ranked
"""
