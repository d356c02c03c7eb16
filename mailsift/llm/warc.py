"""WARC archives: written and read as Spark text files whose line separator ends a record.

One record per page. Payloads travel in HTTP responses with chunked transfer framing. A response
longer than ``segment_bytes`` is split into a first segment and continuation records. Reading
groups continuation records by their origin, orders them by segment number, verifies the total
length, undoes the framing and checks the payload's digest.

Defined cases: a null payload is empty; among equal payloads of at least ``min_bytes`` bytes, the
record with the largest page_id is the response and the others revisit it (rows that repeat that
page_id are responses too, and so are all rows of a group without any page_id); shorter payloads
are responses. An empty table gives an empty archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table

VERSION = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
SEPARATOR = RECORD_END + VERSION.decode()
CHUNK = 1 << 14
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _floor(data: bytes, at: int) -> int:
    """The last place up to ``at`` that doesn't split a UTF-8 character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing. No chunk holds a record's first line, so separators stay unique."""
    out, cuts = [], [m.start() + 4 for m in re.finditer(re.escape(VERSION), payload)] + [len(payload)]
    at = 0
    for end in cuts:
        while at < end:
            stop = min(end, at + CHUNK)
            stop = _floor(payload, stop) if stop < end else stop
            stop = stop if stop > at else end
            out.append(b"%x\r\n%b\r\n" % (stop - at, payload[at:stop]))
            at = stop
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + head.encode() + b"\r\n" + block


def _header_value(text: object) -> str | None:
    """A value for one header line: control characters and blanks are percent-encoded."""
    if not isinstance(text, str):
        return None
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def records(uid: str, page_id: int | None, url: object, payload: bytes, refers_uid: str | None, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response, with its continuation records, or a revisit."""
    own = [("WARC-Record-ID", f"<urn:page:{uid}>"), ("WARC-Target-URI", _header_value(url)), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("X-Page-Id", page_id)]
    if refers_uid is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), *own, ("WARC-Refers-To", f"<urn:page:{refers_uid}>"), ("X-Refers-To-Page", refers_to)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *own], block)
        return
    at, number = 0, 1
    while at < len(block):
        end = min(len(block), at + segment_bytes)
        end = _floor(block, end) if end < len(block) else end
        end = end if end > at else min(len(block), at + segment_bytes)
        last = [("WARC-Segment-Total-Length", len(block))] if end == len(block) else []
        if number == 1:
            yield _record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1)], block[:end])
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{uid}:{number}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{uid}>"), ("WARC-Segment-Number", number), *last], block[at:end])
        at, number = end, number + 1


def write_archive(pages: DataFrame, path: str, segment_bytes: int = 32768, min_bytes: int = 0) -> None:
    """Writes a gzip-compressed archive of all pages below ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Only digests and ids are grouped, and summed up before the shuffle; groups of one drop out.
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("latest")).filter("n > 1 and latest is not null").select("digest", "latest")
    groups = cut(groups, "groups")  # as a table, so that the join reads both sides by plain shuffles and can split a hot payload
    marked = rows.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("latest")), F.col("latest")))
    # A repeated or missing page_id must not join the segments of two records.
    marked = marked.select("page_id", "url", "payload", "refers_to", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.monotonically_increasing_id().cast("string")).alias("uid"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page, url, payload, refers, uid in zip(f.page_id.astype(object), f.url, f.payload, f.refers_to.astype(object), f.uid, strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                out += records(uid, page, url, payload, None if refers is None else str(refers), refers, segment_bytes)
            yield pd.DataFrame({"value": out})

    marked.mapInPandas(build, "value binary").select(F.col("value").cast("string")).write.text(path, compression="gzip", lineSep=RECORD_END)


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    size = int(fields["Content-Length"])
    if len(rest) < size:
        raise ValueError("a record is shorter than its Content-Length")
    return fields, rest[:size]


def _payload(block: bytes, fields: dict[str, str] | None = None, digest: str | None = None) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    digest = digest or (fields or {})["WARC-Payload-Digest"]
    if f"sha1:{sha1_base32(payload)}" != digest:
        raise ValueError("a payload doesn't match its digest")
    return payload


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit: its id, payload size, digest, type and what it refers to.

    with_payload adds the bytes of each response (null for revisits).
    """
    part = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segment long, total long, block binary"

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in part.split(", ")]
        for f in frames:
            out = []
            for raw in f.value:
                if not raw.strip():
                    continue
                fields, block = _parsed(raw.removeprefix(VERSION))
                kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "")
                page, refers = (int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page"))
                segment = int(fields["WARC-Segment-Number"]) if "WARC-Segment-Number" in fields else None
                total = int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None
                origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                size, keep = None, None
                if kind == "revisit":
                    size = int(re.search(rb"(?i)content-length: (\d+)", block)[1])
                elif segment is None:
                    payload = _payload(block, fields)
                    size, keep = len(payload), payload if with_payload else None
                else:
                    keep = block
                out.append((origin, page, size, digest or None, kind, refers, segment, total, keep))
            g = pd.DataFrame(out, columns=names)
            yield g.astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to", "segment", "total")})

    def join_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes, payloads = [], []
            for size, payload, segments, total, digest in zip(f.payload_bytes, f.payload, f.segments, f.total, f.payload_digest, strict=True):
                if len(segments):
                    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                        raise ValueError("a segment is missing")
                    block = b"".join(s["block"] for s in segments)
                    if pd.isna(total) or len(block) != int(total):
                        raise ValueError("segments don't add up to the total length")
                    payload = _payload(block, digest=digest)
                    size, payload = len(payload), payload if with_payload else None
                sizes.append(int(size))
                payloads.append(payload)
            yield f.assign(payload_bytes=sizes, payload=payloads)[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]]

    lines = spark.read.text(path, lineSep=SEPARATOR).select(F.col("value").cast("binary").alias("value"))
    rows = lines.mapInPandas(parse, part)
    # Whole records pass by; only segments carry their blocks through the shuffle.
    whole = F.col("segment").isNull()
    one = rows.groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest", "refers_to", "total")),
        F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
        F.max(F.when(whole, F.col("block"))).alias("payload"),
        F.sort_array(F.collect_list(F.when(~whole, F.struct("segment", "block")))).alias("segments"),
    )
    out = one.mapInPandas(join_up, f"{RESULT}, payload binary")
    out = out.withColumn("payload_digest", F.substring_index("payload_digest", ":", -1))
    return out if with_payload else out.drop("payload")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INT), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM g
"""
