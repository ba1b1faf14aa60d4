"""WARC archives: one gzip member a record, written in parallel and read sequentially.

``write`` turns pages into archives in a folder every executor reaches; ``read`` goes through them with bounded memory: compressed
bytes come in pieces, ``zlib`` inflates one member at a time as they come, the header block ends at an empty line, Content-Length
says how many bytes of the block follow, and digests are taken over them as they pass.

Of pages with equal payloads the smallest id is written as a response, the others as revisits that refer to it (no payload, the
header block of the response only). A page with a null id refers to the smallest; if all ids of a payload are null, all of its pages
are responses. Rows that repeat a smallest id are responses each. Null html is an empty payload. Null urls become
``about:blank``; characters that a header line can't hold are percent-encoded. Other columns are ignored. An
empty table gives no archive, and reading none gives no rows.

A task writes under a name of its own attempt, and only the names that came back from the tasks that succeeded are read; what
a lost or repeated attempt leaves behind is not.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnwave.llm.util import slices, small_batches
from vulnwave.session import cut_lineage, scratch_path

PIECE = 1 << 16
# Uncompressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
# Bound on the HTTP header within a block; the header of a record itself is as long as its url makes it.
LONGEST_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class BadRecord(Exception):
    """A record that doesn't follow the format."""


class BadMember(BadRecord):
    """A gzip stream that can't be read on, so that the start of the next record isn't known."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Store and path of a URI or a local path."""
    if not urlsplit(uri).scheme:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


# ---- writing


def _member(headers: list[tuple[str, str]], block: bytes, kind: str, level: int) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(head.encode()) + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A gzip member with a response, or with a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return _member(headers, block, "response" if refers_to is None else "revisit", level)


def with_firsts(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), refers_to: the smallest id with an equal payload, null if that is the row itself."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    # copies meet as one row a task, and only payloads that occur twice come back
    groups = pages.select("page_id", F.sha1(payload).alias("same")).groupBy("same")
    firsts = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = rows.join(firsts, F.col("digest") == F.col("same"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return found.select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages below ``folder``; path and records of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name = out = None
        n = size = 0
        for batch in slices(batches, "payload", 4 << 20):
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[k].as_py() for c in columns)
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                    out.write(_member([("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", "warcinfo", 6))
                out.write(record(page_id, url, payload, sha1_base32(payload), refers_to))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield _listed(folder, name, n)
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            yield _listed(folder, name, n)

    return with_firsts(small_batches(pages)).mapInArrow(run, "path string, records long")


def _listed(folder: str, name: str, records: int) -> pa.RecordBatch:
    path = f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"
    return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})


# ---- reading


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int = 0
    payload_digest: str = ""
    block_digest: str = ""
    error: str | None = None

    def header(self, name: str) -> str | None:
        return self.headers.get(name.lower())


class Members:
    """Inflated bytes of the members of a gzip file, one member at a time."""

    def __init__(self, source: BinaryIO, piece: int = PIECE):
        self.source, self.piece = source, piece
        self.raw = b""

    def more(self) -> bool:
        """Is there another member?"""
        if not self.raw:
            self.raw = self.source.read(self.piece)
        return bool(self.raw)

    def member(self) -> Iterator[bytes]:
        """Pieces of the next member, of bounded size each."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    raise BadMember("the file ends within a member")
            try:
                out = inflate.decompress(self.raw, self.piece)
            except zlib.error as e:
                raise BadMember(f"not a gzip member: {e}") from None
            self.raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                yield out


class _Bytes:
    """Framing over the pieces of a member."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def until_blank_line(self) -> bytes:
        held, at = bytearray(self.held), 0
        while (end := held.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(held)
            piece = next(self.pieces, None)
            if piece is None:
                raise BadRecord("the header block doesn't end")
            held += piece
        head, self.held = bytes(held[: end + 2]), bytes(held[end + 4 :])
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.held:
                piece = next(self.pieces, None)
                if piece is None:
                    raise BadRecord("the block is shorter than its Content-Length")
                self.held = piece
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        """What follows the block: an empty line twice, and no more."""
        found = self.held
        for piece in self.pieces:
            if len(found) <= 4:
                found += piece
        self.held = b""
        return found


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines if ":" in line)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def _one(pieces: Iterator[bytes], keep: bool) -> Record:
    source = _Bytes(pieces)
    version, headers = _fields(source.until_blank_line())
    if not version.startswith("WARC/"):
        raise BadRecord("no WARC version line")
    found = Record(headers)
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise BadRecord("no Content-Length")
    block, payload = hashlib.sha1(), hashlib.sha1()
    http = headers.get("content-type", "").startswith("application/http")
    head, kept = b"" if http else None, []
    for part in source.take(int(length)):
        block.update(part)
        if head is not None:
            head += part
            end = head.find(b"\r\n\r\n")
            if end < 0:
                if len(head) > LONGEST_HEADER:
                    raise BadRecord("no end of the HTTP header")
                continue
            part, found.http, head = head[end + 4 :], _fields(head[: end + 2])[1], None
        payload.update(part)
        found.payload_bytes += len(part)
        if keep:
            kept.append(part)
    found.payload = b"".join(kept) if keep else None
    found.payload_digest = base64.b32encode(payload.digest()).decode()
    found.block_digest = base64.b32encode(block.digest()).decode()
    wrong = []
    if headers.get("warc-block-digest", f"sha1:{found.block_digest}") != f"sha1:{found.block_digest}":
        wrong.append("block digest")
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", f"sha1:{found.payload_digest}") != f"sha1:{found.payload_digest}":
        wrong.append("payload digest")
    if source.rest() != b"\r\n\r\n":
        wrong.append("record end")
    found.error = ", ".join(wrong) or None
    return found


def records(source: BinaryIO, keep: bool = True) -> Iterator[Record]:
    """The records of an archive in order.

    A record that breaks the format comes back as one with ``error`` and nothing else; the rest of its member is inflated, and the reading
    goes on with the next. Only a gzip stream that can't be inflated, or that the file cuts short, ends the reading, with such a record too.
    """
    members = Members(source)
    while members.more():
        pieces = members.member()
        try:
            try:
                found = _one(pieces, keep)
            except BadMember:
                raise
            except BadRecord as e:
                found = Record({}, error=str(e))
                for _ in pieces:
                    pass
        except BadMember as e:
            yield Record({}, error=str(e))
            return
        yield found


ROWS = (
    "path string, record_id string, record_type string, uri string, refers_to string, http_length long, "
    "payload_bytes long, payload_digest string, digest_header string, error string, payload binary"
)


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the archives in column ``path``, in columns as in ``ROWS``.

    ``payload=False`` leaves the payloads out (null), so that a task holds a few kilobytes of a record at a time.
    Records that break the format, or whose digests are wrong, have an ``error``.
    """
    names = [c.split()[0] for c in ROWS.split(", ")]

    def row(path: str, r: Record) -> tuple:
        length = r.http.get("content-length")
        return (
            path, r.header("WARC-Record-ID"), r.header("WARC-Type"), r.header("WARC-Target-URI"), r.header("WARC-Refers-To"),
            int(length) if length and length.isdigit() else None, r.payload_bytes, r.payload_digest or None,
            (r.header("WARC-Payload-Digest") or "").removeprefix("sha1:") or None, r.error, r.payload,
        )

    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 3 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = file_system(path)
                with store.open_input_stream(name, compression=None) as source:
                    held, size = [], 0
                    for r in records(source, payload):
                        held.append(row(path, r))
                        size += len(r.payload or b"") + sum(map(len, r.headers.values())) + 500
                        if size > 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.select("path").mapInArrow(run, ROWS)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, (10 * (i // 8) + 1)::BIGINT, 10))::BIGINT) >> (35 - 5 * (i % 8))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to,
  NULL::VARCHAR AS error
FROM f
"""


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages as read back from their archives."""
    archives = cut_lineage(write(pages, scratch_path(spark, "warc")))
    lists = archives.select("path").repartition(max(1, archives.count()))  # an archive a task
    found = read(lists, payload=False).where("record_type is null or record_type <> 'warcinfo'")
    revisit = F.col("record_type") == "revisit"
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    return found.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest_header")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(number("refers_to") != "", number("refers_to").cast("long")).alias("refers_to"),
        "error",
    )
