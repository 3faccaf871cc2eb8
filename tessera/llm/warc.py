"""WARC archives, index first.

Writing: each task packs its records into archive files in the shared folder and returns the index, a row per record
with the file's URI, offset, length, target URL and payload digest.  Reading: the index alone is filtered and sorted,
neighbouring byte ranges are coalesced, and each range is read once; nothing else of the archives is touched.

Records are gzip members of their own, so any byte range of the index is a readable stream.  Of pages with equal
payloads of at least ``least`` bytes, the one with the smallest id is a ``response`` record and the others are
``revisit`` records that refer to it; the payload of a revisit is not stored, its HTTP header keeps the full length.

Defined results: null html is an empty payload; a null URL is written as ``about:blank``; a null page id is written as an
empty id and read back as null, and is never referred to while another page of the group has an id; repeated rows give
a record each, with equal ids where ids repeat (the copies revisit the id that they share); an empty table gives no
archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import put_bytes, scratch, settle, table

ARCHIVE_BYTES = 64 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20

_INDEX = "page_id long, url string, digest string, record_type string, payload_bytes long, file string, offset long, length long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, record_type, refers_to) of each page.

    Groups of equal payloads are reduced, before the shuffle and after it, to one row each; only groups of several pages
    meet the pages again, in a join whose page side Spark can split where one payload is very common.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    base = pages.select("page_id", "url", "html", F.sha1(payload).alias("key"))
    groups = pages.select("page_id", F.sha1(payload).alias("key"), F.octet_length(payload).alias("n")).groupBy("key").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    shared = groups.where((F.col("copies") > 1) & (F.col("n") >= least) & F.col("original").isNotNull()).select("key", "original")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return base.join(shared, "key", "left").select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record, its payload included."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    ident = lambda name: int(fields[name][12:-1]) if len(fields.get(name, "")) > 13 else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload does not match its header")
    return {"page_id": ident("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident("WARC-Refers-To"), "payload": payload}


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per page below folder and returns the settled index.

    A file takes its place by a rename once it is whole and gets a new name in every attempt of a task, so what lost or
    repeated tasks leave behind is never in the index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            put_bytes(uri, *members)
            columns = list(zip(*[(*row[:5], uri, *row[5:]) for row in rows], strict=True))
            members.clear()
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in _INDEX.split(", ")])

        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                digest = base32_sha1(payload)
                member = record(page_id.as_py(), url.as_py(), payload, digest, kind.as_py(), refers_to.as_py(), date)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(member) + packer.flush()
                rows.append((page_id.as_py(), url.as_py(), digest, kind.as_py(), len(payload), size, len(member)))
                members.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield flush()
        if rows:
            yield flush()

    return settle(with_roles(pages, least).mapInArrow(write, _INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Coalesces sorted (offset, length) pairs of one file: (first row, row after the last, begin, end) of each read."""
    first = 0
    while first < len(rows):
        begin, end, last = rows[first][0], sum(rows[first]), first + 1
        while last < len(rows) and rows[last][0] - end <= gap and sum(rows[last]) - begin <= most:
            end = max(end, sum(rows[last]))
            last += 1
        yield first, last, begin, end
        first = last


def read_records(index: DataFrame, payload: bool = True, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Reads the records that index lists (filter it first to select some) by coalesced ranges, sorted by file and offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            files, offsets, lengths = (batch.column(n).to_pylist() for n in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                store, path = fs.FileSystem.from_uri(files[at])
                with store.open_input_file(path) as source:
                    for first, last, begin, end in ranges(list(zip(offsets[at:to], lengths[at:to], strict=True)), gap, most):
                        data = source.read_at(end - begin, begin)
                        found = [parse(zlib.decompress(data[offsets[at + i] - begin : offsets[at + i] - begin + lengths[at + i]], 31)) for i in range(first, last)]
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] if payload or n != "payload" else None for x in found], k) for n, k in zip(names, kinds, strict=True)], names)
                at = to

    return index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, _READ)


def op10_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back: written, indexed, read by ranges, and described from what was read."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = write_archives(pages, scratch(spark, "warc"))
    return read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
