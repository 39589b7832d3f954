"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Writing.  Every page is a record, a gzip member of its own.  Of records with equal payloads of at
least ``min_bytes`` bytes, that with the largest id is a ``response`` and the others are
``revisit`` records that name it; smaller ones are all responses.  A revisit's block is the
HTTP head, whose Content-Length is that of the full payload.

Reading.  A task has a byte range.  It looks for gzip magic in it, and takes a place for a
member if what is decoded there begins as a WARC record and, after the member and padding of NULs or
white space, there is another member's magic or the file ends.  It owns the records whose members start in its
range and reads on past its end to finish the last.  From a valid member on, it steps from end to
start, and looks for magic only where a member is broken.  The rule is the same for every task, so the
records don't depend on the ranges.

Edge cases: null pages have an empty payload; rows that tie on the largest id are all
responses; null ids are the smallest, written as empty and read as null; null URLs are
empty and read as null; empty payloads are written; an empty table writes no file and gives no rows; other
columns are ignored.  In archives of others, record ids that aren't ours are null; ``payload_digest`` is that of
the payload as read, and ``digest_ok`` says whether the record's own agrees (null: it has none, or none in SHA-1);
a revisit has no payload, so its digest is what the record says, null if nothing; its length is null
without a Content-Length in its HTTP head.  A member that ends in anything else than padding or a member counts
as broken.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .store import create, listing, open_read

MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, file string, offset bigint, digest_ok boolean"
STEP = 1 << 20
PADDING = b"\0\t\n\r "


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed.  ``digest`` is the payload's SHA-1."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uid = lambda x: f"<urn:page:{'' if x is None else x}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", uid(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        *([("WARC-Refers-To", uid(refers_to)), ("WARC-Profile", REVISIT)] if refers_to is not None else []),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def roles(pages: DataFrame, min_bytes: int, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each page."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    # Groups of one need no partner: only digests found twice are met with their pages again.
    shared = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(shared.select("digest", "last"), "digest", "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))) & (F.length("payload") >= min_bytes)
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> int:
    """Of what :func:`roles` gives, one archive a task; the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        n = 0
        with create(f"{folder}/part-{TaskContext.get().partitionId():08d}.warc.gz") as f:
            while first is not None:
                for page_id, url, payload, digest, refers_to in zip(*first.columns, strict=True):
                    f.write(gzip_member(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date)))
                    n += 1
                first = next((b for b in batches if b.num_rows), None)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


class Member(Exception):
    """Not a member, or a broken one."""


class RangeReader:
    """Members that start in ``[start, end)`` of a file."""

    def __init__(self, file: BinaryIO, start: int, end: int, size: int) -> None:
        self.file, self.start, self.end, self.size = file, start, end, size

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def member(self, at: int) -> tuple[bytes, int]:
        """The member at ``at``, decoded, and where it and padding after it end."""
        inflate, out, pos = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof:
                data = self._at(pos, min(STEP, 1 << 14 if pos == at else STEP))
                if not data:
                    raise Member("cut short")
                got = inflate.decompress(data)
                if pos == at and not got.startswith(b"WARC/") and (got or inflate.eof):
                    raise Member("no WARC header")
                out.append(got)
                pos += len(data)
        except zlib.error as e:
            raise Member(str(e)) from e
        end = self._after_padding(pos - len(inflate.unused_data))
        if end < self.size and self._at(end, 3) != MAGIC:
            raise Member("no member follows")
        return b"".join(out), end

    def _after_padding(self, at: int) -> int:
        while at < self.size:
            data = self._at(at, 64)
            rest = data.lstrip(PADDING)
            at += len(data) - len(rest)
            if rest or not data:
                break
        return at

    def _scan(self, at: int) -> int | None:
        """The next place of gzip magic before the end of the range."""
        while at < self.end:
            data = self._at(at, STEP + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found >= 0:
                return at + found if at + found < self.end else None
            at += STEP
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self._scan(self.start)
        while at is not None:
            try:
                data, after = self.member(at)
            except Member:
                at = self._scan(at + 1)
                continue
            yield at, data
            at = after if after < self.end else None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    return fields, rest[: int(size)] if re.fullmatch(r"[0-9]+", size) else rest


def _sha1(field: str | None) -> bytes | None:
    """The SHA-1 that a digest field holds, in base 32 or hex."""
    kind, _, text = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        got = bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())
    except ValueError:
        return None
    return got if len(got) == 20 else None


def _row(at: int, data: bytes, file: str, with_payload: bool) -> tuple | None:
    fields, block = parse(data)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    page = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d{1,18}|-?[1-8]\d{18}|-?9[01]\d{17})>", fields.get(k, ""))) else None
    head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "application/http").startswith("application/http") else (b"", b"", block)
    said = _sha1(fields.get("warc-payload-digest"))
    if kind == "response":
        n, digest = len(payload), hashlib.sha1(payload).digest()
        agrees = None if said is None else said == digest
    else:
        size = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", head)
        n, digest, agrees = int(size[1]) if size else None, said, None
    return page("warc-record-id"), fields.get("warc-target-uri") or None, kind, page("warc-refers-to"), n, digest.hex() if digest else None, payload if with_payload and kind == "response" else None, file, at, agrees


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of a folder's ``.warc.gz`` files, in tasks of ``split_bytes``."""
    ranges = [(uri, at, min(at + split_bytes, size), size) for uri, size in listing(spark, folder, ".warc.gz") for at in range(0, size, split_bytes)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("digest_ok", pa.bool_())])
        for batch in batches:
            for uri, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_read(uri) as f:
                    rows, held = [], 0
                    for at, data in RangeReader(f, start, end, size):
                        row = _row(at, data, uri, with_payload)
                        if row:
                            rows.append(row)
                            held += len(row[6] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)

    given = spark.createDataFrame(ranges, "file string, start bigint, end bigint, size bigint")
    return given.repartition(max(1, len(ranges)), "file", "start").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(roles(pages, min_bytes), folder)
    return read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
