"""WARC archives (operator 7): written by Spark's text sink, read back with boundary-chain verification.

Each record is a row whose text is its header and block; the line separator is the CRLF CRLF that ends a record, so the sink
writes valid archives, commits them atomically and needs no file access of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, checked_broadcast

MAGIC, GAP, HTTP = b"WARC/1.1\r\n", b"\r\n\r\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads below this many bytes are never replaced by a revisit.
LEAST_BYTES = 100


def _records(pages: DataFrame) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, out: str, ws: Workspace, *, least: int = LEAST_BYTES) -> None:
    """Writes pages (page_id, url, html; null html: empty payload) as archives under `out`. Of equal payloads of at least
    `least` bytes, that of the smallest page_id is a response, others (a null page_id included) are revisits that refer to it.
    Digests are grouped with partial aggregates and joined back only where they repeat, so a payload of many pages isn't dealt
    to one task; payload bytes are not shuffled unless the repeated digests are too many to broadcast."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    first = p.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = ws.stage(first.select("digest", "first"), "repeated")
    p = p.join(checked_broadcast(first, 100), "digest", "left")
    p = p.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    p.select(_records(p)).write.option("lineSep", GAP.decode()).text(out)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, dict[bytes, bytes]]]]:
    """(offset, successor, headers) of all places that look like a record: the magic, header lines, a length, and room for the
    block and the CRLF CRLF after it. The successor is where the next record must start."""
    at, nxt, heads, i = [], [], [], data.find(MAGIC)
    while i >= 0:
        stop = data.find(GAP, i)
        if stop >= 0:
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[i + len(MAGIC) : stop].split(b"\r\n"))}
            size = head.get(b"content-length", b"")
            if size.isdigit() and len(size) < 19 and data[(end := stop + 4 + int(size)) : end + 4] == GAP:
                at.append(i)
                nxt.append(end + 4)
                heads.append((stop + 4, head))
        i = data.find(MAGIC, i + 1)
    return np.array(at, np.int64), np.array(nxt, np.int64), heads


def reachable(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 visits, by pointer jumping: reached sets and jumps both double each round."""
    n = len(at)
    if not n or at[0] != 0:
        return np.zeros(n, bool)
    k = np.searchsorted(at, nxt)
    jump = np.append(np.where((k < n) & (at[np.minimum(k, n - 1)] == nxt), k, n), n)  # n: out of the chain
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        if (more[:n] == reached[:n]).all():
            return reached[:n]
        reached, jump = more, jump[jump]


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, broken boolean"


def _page(urn: bytes) -> int | None:
    body = urn.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(body) if body.lstrip(b"-").isdigit() else None


def _reader(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("broken", pa.bool_())])
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            at, nxt, heads = candidates(data)
            rows = []
            on = reachable(at, nxt)
            last = int(nxt[on][-1]) if on.any() else 0
            for k in np.flatnonzero(on):
                start, head = heads[k]
                body = data[start : nxt[k] - 4]
                kind = head.get(b"warc-type", b"").decode()
                payload = None if kind == "revisit" else body.partition(GAP)[2]
                digest = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
                size = int(head.get(b"x-payload-length", b"-1"))
                if payload is not None:  # what the header says is held against the bytes
                    broken = (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest)
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                else:
                    broken = False
                refers = _page(head[b"warc-refers-to"]) if b"warc-refers-to" in head else None
                rows.append((_page(head.get(b"warc-record-id", b"")), head.get(b"warc-target-uri", b"").decode(), size, digest, kind, refers, payload, broken))
            if last != len(data):  # the chain breaks off before the end of the file
                rows.append((None, None, len(data) - last, None, "broken", None, None, True))
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 1000], strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record that the chain of lengths from a file's start reaches; a magic inside a payload is no record.
    A file whose chain breaks off gives, after its records, one row of type 'broken' with the bytes not read. Files are read whole,
    one a task: the writer's are of a partition's size, and archives of 1 GB need that much memory twice."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return raw.mapInArrow(_reader, _READ)


def warc_round_trip(spark: SparkSession, pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back (see the two functions above): one row for each page,
    repeated rows included (those that equal the response in page_id and payload are responses too). No pages: no rows."""
    ws = Workspace(spark, "warc")
    write_warc(pages, path := ws.path("archive"), ws, least=least)
    return read_warc(spark, path)
