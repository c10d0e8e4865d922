"""WARC archives: writing, reading, and resolving repeated payloads to revisit records.

A record is a header, an empty line, a payload and two line ends, in UTF-8. Spark's text
writer puts records into (gzipped) files, its binary reader reads them, and the reader
here cuts records by Content-Length, so that payloads may hold anything. Resolution
shuffles headers by payload digest, finds the first record of each digest with an
aggregate (a digest that a third of all rows share is a partial count in every task),
joins each record to its original and writes archives with fresh headers: an original
keeps its payload as a response, the others become revisits without one.

Cases: a null html is an empty payload. Records of equal page_id and payload are told
apart by WARC-Record-ID: the smaller one is the response. Null urls and ids are left
out of the header and come back null. Very long payloads are written whole. An empty
table makes empty archives, whose reading gives no rows.

A file is read as one row, so its bytes are bounded: records are written by classes of
size (``CLASSES``), and a file takes as many of a class as fit into ``FILE_BYTES`` at the
class's upper end; a record beyond the last end has a file of its own. Records are taken
out of the compressed stream one at a time. Digests are checked where payloads are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import scratch_path, stored, table

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: Uncompressed bytes of payloads in an archive file, and upper ends of record sizes.
FILE_BYTES = 128 << 20
CLASSES = (1 << 18, 1 << 21, 1 << 24)
#: Characters of payloads that are returned together.
BATCH_CHARS = 4 << 20
RECORD_SCHEMA = (
    "record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, "
    "refers_to long, refers_to_id string, payload string"
)
_TYPES = {"long": pa.int64(), "string": pa.string()}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in RECORD_SCHEMA.split(", ")]
#: The base-32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The base-32 SHA-1 of a string's UTF-8: five hexadecimal digits make four letters."""
    digits = F.sha1(payload.cast("binary"))
    letters = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))


def record_text(has_payload: Column) -> Column:
    """A record, without its last two line ends, from columns of RECORD_SCHEMA.
    WARC-Payload-Length and WARC-Page-ID are extension fields."""
    body = F.when(has_payload, F.coalesce("payload", F.lit(""))).otherwise("")
    return F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")),
        _line("WARC-Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("refers_to_id"), F.lit(">"))),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        _line("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8"),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(END),
        body,
    )


def write(records: DataFrame, path: str, most: int | None = None) -> None:
    """Records (columns of RECORD_SCHEMA) to gzipped archive files under ``path``. ``most``:
    the bytes of the largest payload, or an upper bound of them, where that is known."""
    kept = F.when(F.col("record_type") == "response", F.coalesce(F.octet_length("payload"), F.lit(0))).otherwise(0)
    if most is None:
        most = records.select(kept.alias("b")).agg(F.max("b")).first()[0] or 0
    low = -1
    for high in (*CLASSES, None):
        if low < most or low < 0:
            some = records if low < 0 and most <= high else records.where((kept > low) & ((kept <= high) if high else F.lit(True)))
            text = some.select(record_text(F.col("record_type") == "response").alias("value"))
            text.write.mode("append").options(lineSep=END, compression="gzip", maxRecordsPerFile=max(1, FILE_BYTES // high) if high else 1).text(path)
        low = high


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each row of ``pages`` (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.lit("response").alias("record_type"), F.uuid().alias("record_id"), "page_id", "url", base32_sha1(html).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_id"), html.alias("payload"),
    )


def _parse(stream: BinaryIO, payloads: bool) -> Iterator[tuple]:
    while first := stream.readline():
        if first.rstrip(b"\r\n") != VERSION.encode():
            raise ValueError(f"no record at {first[:40]!r}")
        lines = iter(stream.readline, b"\r\n")
        head = dict(x.decode().rstrip("\r\n").split(": ", 1) for x in lines)
        body = stream.read(int(head["Content-Length"]))
        stream.read(len(END))
        uid = lambda k: head[k][10:-1] if k in head else None
        number = lambda k: int(head[k]) if k in head else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if payloads and head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
        yield (
            head["WARC-Type"], uid("WARC-Record-ID"), number("WARC-Page-ID"), head.get("WARC-Target-URI"), digest, number("WARC-Payload-Length"),
            number("WARC-Refers-To-Page-ID"), uid("WARC-Refers-To"), body.decode() if payloads else None,
        )


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for row in _parse(gzip.open(pa.BufferReader(content.as_buffer())), payloads):
                    rows.append(row)
                    size += len(row[-1] or "")
                    if len(rows) == 500 or size > BATCH_CHARS:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archive files under ``path``; with ``payloads`` the digest of every
    response is checked against them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_reader(payloads), RECORD_SCHEMA)


def resolve(spark: SparkSession, path: str, out: str, least_bytes: int = 0) -> None:
    """The archives under ``path``, deduplicated, to ``out``. Payloads under
    ``least_bytes`` stay responses."""
    all_heads = stored(read(spark, path, payloads=False).select("payload_digest", "payload_bytes", "page_id", "record_id"), "warc-heads")
    most = all_heads.agg(F.max("payload_bytes")).first()[0] or 0
    heads = all_heads.where(F.col("payload_bytes") >= least_bytes)
    first = heads.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")).alias("first"))
    repeats = (
        heads.select("payload_digest", "record_id").join(first, "payload_digest")
        .where(F.col("record_id") != F.col("first.record_id"))
        .select("record_id", F.col("first.page_id").alias("_page"), F.col("first.record_id").alias("_id"))
    )
    revisit = F.col("_id").isNotNull()
    resolved = read(spark, path).join(repeats, "record_id", "left").withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.col("_page"), "refers_to_id": F.col("_id"),
    })
    write(resolved, out, most)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, out = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")), raw)
    resolve(spark, raw, out)
    return read(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p
), b AS (
  SELECT page_id, payload_bytes,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}', (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
