"""WARC archives: a writer with revisit records, and a sequential reader.

Writer: one gzip member per record. Of the rows with equal payloads (of at least min_bytes bytes) that with the smallest
id becomes a response, the others revisits that refer to it. Archives are rolled at about ROLL bytes and kept as rows
(archive, content) of a table in the shared folder, so Spark commits them and a lost executor leaves no half archive;
content is a plain .warc.gz file.

Reader: feeds an archive to zlib piece by piece (memory is bounded by a piece, whatever the record's size), takes one
member per record, frames the block by Content-Length and verifies block and payload digests; a wrong length, digest or
a cut member raises WarcError. read_archives() takes archives out of cells, as the writer makes them (of ROLL bytes, or one
record); read_archive_files() opens files of any size where the task runs.

A null payload is an empty one. Null or repeated ids: a row with a null id, or with the smallest id of its group, is a
response. Null urls give a record without a target; control characters in urls are percent-encoded. Very long payloads
make an archive of their own. An empty table gives no archives and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark import TaskContext

from .util import sliced, stored, table, utf8

ROLL = 8 << 20
#: Pages that are taken, and records that are given, at a time.
PAGES, RECORDS_OUT = 128, 4096
PIECE = 64 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'none' if record_id is None else record_id}>"


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member. A revisit holds the HTTP header alone; digest and length are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def pieces(content: bytes, size: int = PIECE) -> Iterator[bytes]:
    view = memoryview(content)
    for i in range(0, len(view), size):
        yield view[i : i + size]


class Reader:
    """Iterates over the records of one archive, given as pieces of its bytes: (headers, payload's length in the block, its digest)."""

    def __init__(self, source: Iterable[bytes]):
        self._source = iter(source)
        self._left = b""  # compressed bytes not yet used
        self._data = bytearray()  # plain bytes of the member not yet used

    def _more(self, member) -> bool:
        """Adds plain bytes of the member; False at its end."""
        if member.eof:
            return False
        raw = self._left or next(self._source, b"")
        self._left = b""
        if not raw:
            raise WarcError("the archive ends within a record")
        self._data += member.decompress(raw, PIECE)
        self._left = member.unused_data if member.eof else member.unconsumed_tail
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], int, str]]:
        while True:
            while not self._left:
                piece = next(self._source, None)
                if piece is None:
                    return
                self._left = piece
            member = zlib.decompressobj(31)
            self._data = bytearray()
            yield self._record(member)

    def _until(self, member, mark: bytes, most: int) -> bytes:
        while (at := self._data.find(mark)) < 0:
            if len(self._data) > most or not self._more(member):
                raise WarcError("a header does not end")
        found = bytes(self._data[:at])
        del self._data[: at + len(mark)]
        return found

    def _record(self, member) -> tuple[dict[str, str], int, str]:
        lines = self._until(member, b"\r\n\r\n", 1 << 20).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a record: {lines[0][:40]}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        left = int(headers["content-length"])
        block, payload, n, head, inside = hashlib.sha1(), hashlib.sha1(), 0, b"", False
        while left:
            if not self._data and not self._more(member):
                raise WarcError("a block is shorter than its Content-Length")
            got = bytes(self._data[:left])
            del self._data[: len(got)]
            left -= len(got)
            block.update(got)
            if not inside:
                head += got
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                inside, got = True, head[at + 4 :]
            payload.update(got)
            n += len(got)
        while not member.eof:
            self._more(member)
        if bytes(self._data) != b"\r\n\r\n":
            raise WarcError("a record does not end with its block")
        text = lambda h: base64.b32encode(h.digest()).decode()
        if headers.get("warc-block-digest") not in (None, f"sha1:{text(block)}"):
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest") not in (None, f"sha1:{text(payload)}"):
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        return headers, n, text(payload)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
    roll = lambda: pa.RecordBatch.from_pydict({"archive": [f"pages-{part:05d}-{number:05d}.warc.gz"], "content": pa.array([b"".join(parts)], pa.binary())})
    for batch in sliced(batches, PAGES):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.append(record(*row))
            size += len(parts[-1])
            if size >= ROLL:
                yield roll()
                number, parts, size = number + 1, [], 0
    if parts:
        yield roll()


def write_archives(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """archive, content: the archives, stored in the shared folder.

    Groups of copies are a stored table of their own, so that Spark can broadcast it or split a payload's many copies.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    repeated = stored(rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "copies")
    joined = rows.join(repeated, "sha", "left")
    refers = F.when(F.col("id") != F.col("first"), F.col("first"))
    return stored(joined.select("id", "url", "payload", refers.alias("refers_to")).mapInArrow(_pack, "archive string, content binary"), "warc")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _records(source: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    number = lambda urn: int(m[1]) if urn and (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn)) else None
    out: list[tuple] = []
    told = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    for h, n, digest in Reader(source):
        revisit = h.get("warc-type") == "revisit"
        said = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest
        size = h.get("x-payload-length") if revisit else n
        out.append((number(h.get("warc-record-id")), None if size is None else int(size), said, h.get("warc-type"), number(h.get("warc-refers-to")), h.get("warc-target-uri")))
        if len(out) >= RECORDS_OUT:
            yield told()
            out = []
    if out:
        yield told()


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """A row per record. archives: as write_archives returns, each within a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if content.is_valid:
                    yield from _records(pieces(content.as_buffer()))

    return archives.select(content_col).mapInArrow(run, RECORDS)


def read_archive_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """A row per record of .warc.gz files of any size: a task opens each path (a URI that Arrow's file systems know) and reads it piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = FileSystem.from_uri(path)
                with system.open_input_stream(inner, compression=None) as file:
                    yield from _records(iter(lambda f=file: f.read(PIECE), b""))

    return paths.select(path_col).where(F.col(path_col).isNotNull()).mapInArrow(run, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read_archives(archives).drop("url")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
