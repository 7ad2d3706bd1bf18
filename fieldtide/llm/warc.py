"""WARC archives without repeated payloads: revisit resolution, writing and reading.

Only headers (page_id, digest, length) are shuffled by digest; a digest's original is a partial minimum, so a digest of a
third of all rows costs one row per task, and only digests with several pages are joined back. A record's text ends with
the blank line that separates records, so Spark's text writer, with that blank line as its separator, writes archives of
records to any file system. Reading parses whole files by the records' lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtide.llm.work import work_folder

_END = "\r\n\r\n"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def resolve(headers: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Distinct (page_id, digest, length) with the original's page_id in ``refers_to`` for revisits, else null.

    Of payloads of at least ``least_bytes`` with one digest the smallest page_id is the original, a null id last.
    """
    pages = headers.select("page_id", "digest", "length").distinct()
    first = pages.filter(F.col("length") >= least_bytes).groupBy("digest", "length").agg(
        F.min("page_id").alias("original"), F.count(F.lit(1)).alias("pages"))
    first = first.filter("pages > 1").select("digest", "length", "original")
    found = pages.join(first, ["digest", "length"], "left")
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).drop("original")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 100) -> DataFrame:
    """One row per page with its whole record in ``value``. A null html is an empty payload; a null url has no target."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("bigint").alias("length"))
    # Pages that repeat whole, or null ids, keep their rows: the join is on id and digest, one row each on the right.
    found = resolve(rows, least_bytes).select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to")
    rows = rows.join(found, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("length").cast("string"), F.lit(_END))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, body).alias("value"))


def write_archives(pages: DataFrame, folder: str, per_file: int = 20_000, **options) -> None:
    """Archives of at most ``per_file`` records each, compressed with gzip."""
    records(pages, **options).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def _number(value: str | None) -> int | None:
    value = value.strip("<>").rpartition(":")[2] if value else "none"
    return None if value == "none" else int(value)


def parse(data: bytes) -> Iterator[tuple]:
    """Records of an archive: (page_id, payload_bytes, digest, type, refers_to, url, payload); a digest must fit its payload."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block_at = stop + 4
        block_end = block_at + int(head["Content-Length"])
        http_end = data.index(b"\r\n\r\n", block_at) + 4
        length = int(data[block_at:http_end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = head["WARC-Type"]
        payload = data[http_end:block_end] if kind == "response" else None
        if payload is not None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {head['WARC-Record-ID']} does not fit its digest")
        yield _number(head["WARC-Record-ID"]), length, digest, kind, _number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), payload
        at = block_end + len(_END)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives in a folder. Files are at most a partition's records, so a task holds one at a time."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_py()
                found = parse(zlib.decompress(raw, 31) if path.endswith(".gz") else raw)
                rows = [r if with_payload else (*r[:-1], None) for r in found]
                if rows:
                    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(scan, _READ)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives into a new folder of the shared folder and reads them back without payloads."""
    folder = work_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder, with_payload=False)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100
"""
