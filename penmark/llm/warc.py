"""WARC (operator 3): archives and their chunked record table.

Writing.  Each page becomes a WARC/1.1 record; of the records whose payloads are
equal and not tiny, the one with the smallest page_id is the response and the
others are revisit records without payload.  Records leave as text rows, one
per line of the archive, cut from the payload piece by piece; Spark's text writer
puts them into gzip-compressed files, so any store Spark can write to will do.
The archive's bytes are those of the record format, headers and CRLFs included.

Reading.  A gzip file is read by one task in order, line by line.  The reader
follows the headers and the content length and passes the payload on as
(record_id, chunk_no, chunk) rows of at most ``CHUNK_BYTES`` while it runs
a SHA-256 over what went by; the record's last row carries the digest and the
length.  No step holds a whole record that is larger than a chunk
and one line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.llm.common import map_columns, shared_path, stored

CHUNK_BYTES = 1 << 18
MIN_REVISIT_BYTES = 100
# --- FIXED VALUES: names of the record format ---
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
LENGTH_HEADER = "X-Payload-Length"


def with_digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest); a null html is an empty payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
                        F.sha2(html, 256).alias("payload_digest"))


def assign_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages that revisit another one.

    Equal payloads are found by digest with map-side partial aggregation; only
    groups of several pages are joined back, and Spark may split a hot group's
    side of that join since both sides are plain scans."""
    d = with_digest(pages).where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    d = stored(d.select("page_id", "payload_digest"), "warc-digests")
    first = stored(d.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("payload_digest", "first_id"), "warc-first")
    return d.join(first, "payload_digest").where(F.col("page_id") != F.col("first_id")) \
            .select("page_id", "payload_digest", F.col("first_id").alias("refers_to")).distinct()


def record_lines(page_id: int | None, url: str | None, html: str, size: int, digest: str,
                 refers_to: int | None) -> Iterator[str]:
    """The lines of one record, each without its final LF."""
    target = "".join(c for c in url or "" if c not in "\r\n")
    yield f"{VERSION}\r"
    yield f"WARC-Type: {'response' if refers_to is None else 'revisit'}\r"
    yield f"WARC-Record-ID: <{RECORD_URN}{'' if page_id is None else page_id}>\r"
    yield f"WARC-Target-URI: {target}\r"
    yield f"WARC-Payload-Digest: sha256:{digest}\r"
    yield f"{LENGTH_HEADER}: {size}\r"
    if refers_to is not None:
        yield f"WARC-Refers-To: <{RECORD_URN}{refers_to}>\r"
        yield f"WARC-Profile: {REVISIT_PROFILE}\r"
        yield "Content-Length: 0\r"
        yield "\r"
        yield "\r"
    else:
        yield "Content-Type: text/html\r"
        yield f"Content-Length: {size}\r"
        yield "\r"
        at = 0
        while (end := html.find("\n", at)) >= 0:
            yield html[at:end]
            at = end + 1
        yield html[at:] + "\r"
    yield "\r"


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) under ``path``.

    A null html is an empty payload; a null page_id gets an empty record name
    and neither revisits nor is revisited.  Rows that repeat a page_id are all written;
    copies of the response's row are responses too."""
    rows = with_digest(pages).join(assign_types(pages, min_bytes), ["page_id", "payload_digest"], "left")
    columns = ["page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches):
        for b in batches:
            lines, held = [], 0
            for row in zip(*(b[c] for c in columns)):
                for line in record_lines(*row):
                    lines.append(line)
                    held += len(line)
                    if held > 1 << 22:
                        yield {"value": lines}
                        lines, held = [], 0
            if lines:
                yield {"value": lines}

    map_columns(rows.select(*columns), run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def parse(lines: Iterator[bytes]) -> Iterator[dict]:
    """Chunk rows of the records in a stream of archive lines."""
    headers: dict[str, str] | None = None
    for line in lines:
        if headers is None:
            if line == b"\r":
                continue            # the blank lines after a record
            if line != VERSION.encode() + b"\r":
                raise ValueError(f"not the start of a record: {line[:80]!r}")
            headers, left = {}, -1
        elif left < 0:
            if line != b"\r":
                name, _, value = line.decode().rstrip("\r").partition(":")
                headers[name.lower()] = value.strip()
                continue
            left = int(headers["content-length"])
            sha, total, number, held = hashlib.sha256(), 0, 0, bytearray()
            if left == 0:
                yield last_row(headers, 0, b"", sha, 0)
                headers = None
        else:
            # the line's own LF is payload unless the payload ended before it; a payload that
            # ends with LF is complete when the next line brings the CR after it
            view = memoryview(line)
            take = min(left, len(line))
            for i in range(0, take, CHUNK_BYTES):
                piece = view[i:min(i + CHUNK_BYTES, take)]
                sha.update(piece)
                held += piece
                while len(held) >= CHUNK_BYTES:
                    yield chunk_row(headers, number, bytes(held[:CHUNK_BYTES]))
                    del held[:CHUNK_BYTES]
                    number += 1
            left -= take
            total += take
            if left and take == len(line):
                sha.update(b"\n")
                held += b"\n"
                left -= 1
                total += 1
            if left == 0 and take < len(line):
                yield last_row(headers, number, bytes(held), sha, total)
                headers = None
    if headers is not None:
        raise ValueError("an archive ends within a record")


def record_id(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(RECORD_URN)
    return int(digits) if digits else None


def chunk_row(h: dict, number: int, chunk: bytes) -> dict:
    return {"record_id": record_id(h.get("warc-record-id")), "record_type": h.get("warc-type"), "chunk_no": number,
            "chunk": chunk, "is_last": False, "refers_to": record_id(h.get("warc-refers-to")), "payload_bytes": None,
            "payload_digest": None, "stored_digest": None}


def last_row(h: dict, number: int, chunk: bytes, sha, total: int) -> dict:
    named = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
    revisit = h.get("warc-type") == "revisit"
    length = h.get(LENGTH_HEADER.lower())
    return chunk_row(h, number, chunk) | {
        "is_last": True, "payload_bytes": (int(length) if length else None) if revisit else total,
        "payload_digest": named if revisit else sha.hexdigest(), "stored_digest": named}


CHUNK_SCHEMA = ("record_id bigint, record_type string, chunk_no bigint, chunk binary, is_last boolean, refers_to bigint, "
                "payload_bytes bigint, payload_digest string, stored_digest string")


def read_archives(spark: SparkSession, path: str, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of the archives under ``path``.  A record's
    last row (``is_last``) carries its payload's length and digest: for a
    response as read, for a revisit as named in its headers."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches):
        lines = (x for b in batches for x in b["value"])
        out, held = [], 0
        for r in parse(lines):
            if not with_chunks:
                if not r["is_last"]:
                    continue
                r["chunk"] = None
            out.append(r)
            held += 200 + len(r["chunk"] or b"")
            if held > 1 << 23:
                yield {k: [x[k] for x in out] for k in out[0]}
                out, held = [], 0
        if out:
            yield {k: [x[k] for x in out] for k in out[0]}

    return map_columns(rows, run, CHUNK_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder and read them
    back: per record page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, with_chunks=False).where("is_last").select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
