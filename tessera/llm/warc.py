"""WARC archives with revisit records.

Headers (id, URL, digest, size; never payloads) are shuffled by payload digest; of equal payloads of at least
LEAST_REVISIT bytes the record with the largest page_id stays a response, the others become revisit
records that refer to it. Revisits are written from their headers. Responses are written where their payloads lie: up to
MOST_TOLD revisits (about 100 bytes each) are broadcast for the scan to leave out; only beyond that is the scan joined
to them by a shuffle. Archives are written anew, every record a gzip member with fresh headers; read back, revisits
are joined to the responses they refer to.

Defined results: null html is an empty payload; null url gives no target URI; a null page_id is smaller
than any other and revisits like it, and where all are null each is a response; rows that share the largest
page_id and the payload are all responses; an empty table gives no archive and an empty result. Whole
payloads are written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.llm.common import written

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 4 << 20
MOST_TOLD = 300_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, n_records long, data binary"
RECORDS = "page_id long, record_id string, record_type string, refers_to_id string, target_uri string, payload binary, payload_bytes long, payload_digest string, sound boolean"
_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def record_id(page_id: int | None, digest: str) -> str:
    """A fresh URN that is the same whenever a task is run again."""
    h = hashlib.sha1(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _uri(url: str) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]|")


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, original: int | None, original_url: str | None, date: str) -> bytes:
    """One record; a revisit, which needs no payload, if original is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if original is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}"]
        if original_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(original_url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, HTTP headers, payload) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        head = {k.decode().lower(): v.decode() for k, v in _LINE.findall(data[data.index(b"\r\n", at) + 2 : stop + 2])}
        block = data[stop + 4 : stop + 4 + int(head["content-length"])]
        cut = block.index(b"\r\n\r\n") + 4
        yield head, {k.decode().lower(): v.decode() for k, v in _LINE.findall(block[:cut])}, block[cut:]
        at = stop + 4 + len(block) + 4


def resolve(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Headers of the pages that are revisits, with the page_id and url of their originals."""
    heads = pages.where(F.col("_size") >= least).select("page_id", "url", "_size", "_digest")
    # written before the join, so that it can split a digest with very many rows
    originals = written(heads.groupBy("_digest").agg(F.max("page_id").alias("_original"), F.max_by("url", "page_id").alias("_original_url"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _original is not null").drop("_n"), "originals")
    return heads.join(originals, "_digest").where(~F.col("page_id").eqNullSafe(F.col("_original")))


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of all pages (page_id, url, html): each row holds the bytes of one .warc.gz file.

    They are written to the shared folder and read from there.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload")).withColumn("_size", F.octet_length("_payload").cast("long"))
    columns = ["page_id", "url", "_payload", "_size", "_digest", "_original", "_original_url"]
    found = written(resolve(rows, least).withColumn("_payload", F.lit(None).cast("binary")).select(*columns), "revisits")
    gone = found.select(F.col("page_id").alias("_page"), F.col("_digest").alias("_same")).distinct()
    if found.count() <= MOST_TOLD:
        gone = F.broadcast(gone)
    else:
        gone = written(gone, "gone")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_digest") == F.col("_same"))
    left = rows.join(gone, same, "left_anti").withColumn("_original", F.lit(None).cast("long")).withColumn("_original_url", F.lit(None).cast("string"))
    told = left.select(*columns).unionByName(found)

    def work(batches):
        held: list[bytes] = []
        size = made = 0
        task = TaskContext.get()
        part_id = task.partitionId() if task else 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part_id:06d}-{made:05d}.warc.gz"]), pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["archive", "n_records", "data"])

        for batch in batches:
            for part in tk.slices(batch, "_payload"):
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    held.append(gzip.compress(make_record(*values, date), 3, mtime=0))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive()
                        held, size, made = [], 0, made + 1
        if held:
            yield archive()

    return written(told.mapInArrow(work, ARCHIVES), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (RECORDS); sound: the payload read has the digest its headers state.

    payloads: whether responses come with their payloads; sizes and digests are of what was read in any case.
    """

    def work(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for head, http, payload in parse_records(gzip.GzipFile(fileobj=io.BytesIO(data.as_py())).read()):
                    digest, response = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "response"
                    page = head.get("warc-page-id")
                    out.append((None if page is None else int(page), head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head.get("warc-target-uri"), payload if response and payloads else None, len(payload) if response else int(http["content-length"]), hashlib.sha1(payload).hexdigest() if response else digest, not response or hashlib.sha1(payload).hexdigest() == digest))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])

    return archives.select("data").mapInArrow(work, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Every record with its full payload's size and digest; those of a revisit are its response's."""
    slim = records.select("page_id", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest")
    response = slim.where("record_type = 'response'")
    found = response.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    revisit = slim.where("record_type = 'revisit'").join(found, "refers_to_id", "left")
    return response.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisit.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    )
