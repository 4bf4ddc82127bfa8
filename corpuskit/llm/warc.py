"""WARC archives without repeated payloads: revisit records point at the response that holds the bytes.

Only headers (id, url, size, digest) are shuffled by payload digest. The first response of each repeated digest is
joined to the headers of its revisits, those decisions meet the pages by page, and each task writes its records as
one archive: ``WARC/1.1`` records as text lines that end in two CRLF, gzip over the whole file. Reading parses the
records again by their Content-Length, so a payload may hold any line.

Defined results: a null html is an empty payload; a null url is written as an empty one; line breaks in a url become
blanks; payloads under ``min_payload`` bytes are always responses; of equal rows with the smallest page_id each is a
response; a null page_id comes after all others; equal payloads that all lack a page_id are responses; an empty
table gives one empty archive; other columns of the table are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import shared_dir

MIN_PAYLOAD = 100
#: Payload bytes that an archive holds, about; one record may be larger.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What tells pages apart; ``page`` is the id as text, so that a missing one is a value too.
KEYS = ("page", "url", "payload_digest")


def headers(pages: DataFrame) -> DataFrame:
    """``page_id, page, url, payload_bytes, payload_digest, html`` of each row."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("")).alias("page"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
        F.coalesce("html", F.lit("")).alias("html"),
    )


def revisits(heads: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page, url, payload_digest, refers_to, refers_url``: one row for each distinct header that revisits another."""
    slim = heads.filter(F.col("payload_bytes") >= min_payload).select("page_id", *KEYS).distinct()
    first = (
        slim.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.min_by("url", F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("refers_url"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
        .drop("n")
    )
    # Skewed digests are split by adaptive execution: both sides are plain exchanges.
    return slim.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(*KEYS, "refers_to", "refers_url")


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(digest, 1, 16), F.lit(">"))


def record(row_type: Column) -> Column:
    """The text of a record up to its block's end."""
    eol = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(eol * 2))
    block = F.when(row_type == "response", F.concat(http, F.col("html"))).otherwise(http)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(eol))
    refers = F.when(
        row_type == "revisit",
        F.concat(
            field("WARC-Profile", F.lit(PROFILE)),
            field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))),
            field("WARC-Refers-To-Target-URI", F.col("refers_url")),
            field("WARC-Refers-To-Date", F.lit(DATE)),
        ),
    ).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{eol}"),
        field("WARC-Type", row_type),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        refers,
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(eol),
        block,
    )


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record a row under ``path``."""
    heads = headers(pages)
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    again = revisits(heads.drop("html"), min_payload)
    # Both sides are dealt by page, so a repeated payload loads no task more than another.
    left, right = heads.repartition(parts, *KEYS), again.repartition(parts, *KEYS)
    both = left.join(right, list(KEYS), "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    both.select(record(kind).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under ``path``. Size and digest of a response are taken from its bytes, of a revisit from its header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(_row(head, block, with_payload))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    out = files.mapInArrow(parse, _SCHEMA)
    return out if with_payload else out.drop("payload")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    lines = io.BufferedReader(stream)
    while line := lines.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while (line := lines.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, lines.read(int(head["content-length"]))


def _page(record_id: str) -> int | None:
    text = record_id.strip("<>").split(":")[2]
    return int(text) if text else None


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    if head["warc-type"] == "response":
        return _page(head["warc-record-id"]), head["warc-target-uri"], len(payload), hashlib.sha256(payload).hexdigest(), "response", None, payload if with_payload else None
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return _page(head["warc-record-id"]), head["warc-target-uri"], size, head["warc-payload-digest"].partition(":")[2], "revisit", _page(head["warc-refers-to"]), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).drop("url")


ORACLE = """
WITH h AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
