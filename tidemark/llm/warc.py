"""Operator 4: web archive derivatives.

Response records become two linked records each: metadata (fields of the fetch, all headers of the source in their order, outgoing links) and
conversion (the page as plain text). Both name the response in WARC-Refers-To, with its target, date and digests kept. Transfer and content
encodings of the body are undone first; digests are those of the payload as it was sent, without its transfer encoding.

Defined results: null addresses and pages become empty ones; a payload that isn't text/html has no conversion record, nor has one whose
encoding is unknown or broken (the metadata's field `decoding` says so); bodies may have any size that a task's memory holds, unless `max_body` bounds
what their encodings come to (then `decoding` says "too large"); all members of a body count; a damaged record (no version line, no blank line, fewer bytes than it
says) gives one row of type `damaged` without links, and the records after it go on; repeated rows give the same records each, with the same ids; an empty
table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import blocks

VERSION, DATE, CRLF = "WARC/1.1", "2024-01-01T00:00:00Z", b"\r\n"
PIECE, ROWS_BYTES = 1 << 20, 16 << 20  #: bytes read at a time, and of the records of one Arrow batch
HEAD_END, LENGTH, VERSION_LINE = re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?i)\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r?\n"), re.compile(rb"WARC/\d\.\d\r?\n")
CHUNK, MEMBER = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n"), b"\x1f\x8b\x08"
RECORDS = "page_id long, source string, record binary"
DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_block_digest string, source_payload_digest string, "
    "source_headers array<struct<name:string,value:string>>, record binary"
)
Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    """The same id for the same input, so that a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((kind, *parts)))}>"


def write_record(headers: list[tuple[str, str]], block: bytes, packed: bool = False) -> bytes:
    clean = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*clean, ("Content-Length", str(len(block)))])
    data = f"{VERSION}\r\n{head}\r\n".encode() + block + CRLF + CRLF
    return gzip.compress(data, mtime=0) if packed else data


def header_lines(data: bytes) -> tuple[str, Headers]:
    """The first line, and every header in its order, by lower-case name; folded lines belong to the one before."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
            continue
        name, colon, value = line.partition(":")
        if colon:
            out.append((name.strip().lower(), value.strip()))
    return first, out


def first(headers: Headers, name: str, default: str = "") -> str:
    return next((v for k, v in headers if k == name), default)


def read_record(data: bytes) -> tuple[Headers, bytes]:
    """Headers (lower-case name, value) and block of one record; ValueError if it is damaged."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, found, rest = data.partition(CRLF + CRLF)
    version, headers = header_lines(head)
    if not found or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    n = int(first(headers, "content-length", "x"))
    if n < 0 or len(rest) < n:
        raise ValueError("record cut off")
    return headers, rest[:n]


class Splitter:
    """Cuts a stream of bytes into records. What can't be read (no version line, no length, or one that doesn't end at a blank line) is cut off before the
    next version line, and comes as it is."""

    def __init__(self) -> None:
        self.data, self.needs = bytearray(), 0

    def feed(self, more: bytes, last: bool = False) -> Iterator[bytes]:
        self.data += more
        while last or len(self.data) >= self.needs:
            del self.data[: len(self.data) - len(self.data.lstrip(b"\r\n"))]
            if not self.data:
                self.needs = 1
                return
            head = HEAD_END.search(self.data)
            if not head and not last:
                self.needs = len(self.data) + 1
                return
            n = LENGTH.search(self.data, 0, head.end()) if head else None
            at = 1
            if self.data.startswith(b"WARC/") and n:
                end, at = head.end() + int(n[1]), head.end()
                if len(self.data) < end + 2 and not last:
                    self.needs = end + 2
                    return
                if self.data[end : end + 2] == CRLF or self.data[end : end + 1] == b"\n" or len(self.data) == end:
                    self.needs = 0
                    yield self._cut(end)
                    continue
            after = VERSION_LINE.search(self.data, at)
            if not after and not last:
                self.needs = 2 * len(self.data)  # looked through again when it has doubled
                return
            self.needs = 0
            yield self._cut(after.start() if after else len(self.data))

    def finish(self) -> Iterator[bytes]:
        yield from self.feed(b"", True)

    def _cut(self, n: int) -> bytes:
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a file of many, plain or gzip (a member for each record, or one for all). After what can't be read the next record, or the next
    member that can be read, goes on; a gap between members comes as one damaged record."""
    splitter = Splitter()
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield from splitter.feed(data[at : at + PIECE])
        yield from splitter.finish()
        return
    at, gap = 0, False
    while 0 <= at < len(data):
        made, start, sent = zlib.decompressobj(zlib.MAX_WBITS | 16), at, 0
        try:
            while not made.eof:
                piece = made.unconsumed_tail or data[at : at + PIECE]
                at += 0 if made.unconsumed_tail else len(piece)
                out = made.decompress(piece, PIECE)
                if not out and not piece:
                    break
                sent += len(out)
                yield from splitter.feed(out)
            at -= len(made.unused_data)
            gap = gap and not made.eof
            if made.eof and data[at : at + 2] == b"\x1f\x8b" or not data[at:].strip(b"\0\r\n"):
                continue
        except zlib.error:
            pass
        # not a member's end: what came of it so far, then the next member
        yield from splitter.finish()
        if not gap and (made.eof or not sent):
            yield b"damaged"
        gap = True
        at = data.find(MEMBER, start + 1 if not made.eof else at)
    yield from splitter.finish()


def undone(body: bytes, headers: Headers, most: int = 0) -> tuple[bytes | None, bytes, str]:
    """The body without its encodings (None if that fails), the payload without its transfer encoding, and what went wrong. most: bytes that an undone
    body may have; 0: any number."""
    try:
        if "chunked" in first(headers, "transfer-encoding").lower():
            parts, at = [], 0
            while True:
                size = CHUNK.match(body, at)
                n = int(size[1], 16) if size else -1
                if n == 0:
                    break
                at = size.end() + n + 2 if size else len(body) + 1
                if at > len(body) or body[at - 2 : at] != CRLF:
                    raise ValueError("no chunk of this size")
                parts.append(body[at - 2 - n : at - 2])
            body = b"".join(parts)
        payload = body
        for kind in reversed([x.strip().lower() for x in first(headers, "content-encoding").split(",") if x.strip()]):
            if kind in ("gzip", "x-gzip", "deflate"):
                bits = zlib.MAX_WBITS | 32 if kind != "deflate" or body[:1] in (b"\x78", b"\x58") else -zlib.MAX_WBITS
                parts, rest, room = [], body, most
                while True:  # a body may have several members
                    made = zlib.decompressobj(bits)
                    parts.append(made.decompress(rest, max(1, room) if most else 0))
                    room -= len(parts[-1])
                    if not made.eof:
                        return None, payload, "too large" if most and made.unconsumed_tail else "broken encoding"
                    rest = made.unused_data
                    if rest[:2] != b"\x1f\x8b":
                        break
                body = b"".join(parts)
            elif kind != "identity":
                return None, payload, f"unknown encoding {kind}"
        return body, payload, ""
    except (ValueError, zlib.error):
        return None, body, "broken encoding"


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    body = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body
    return write_record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url or ""),
                         ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))], block)


def derivatives(data: bytes, packed: bool = False, most: int = 0) -> list[dict]:
    """The metadata and conversion record of a response record."""
    try:
        head, block = read_record(data)
    except (ValueError, OSError, EOFError, zlib.error):
        return [{"record_type": "damaged"}]
    if first(head, "warc-type") != "response":
        return []
    http, _, body = block.partition(CRLF + CRLF)
    status, source = header_lines(http)
    origin, uri, date = (first(head, k) for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    declared, kind = first(head, "warc-payload-digest"), first(source, "content-type")
    content, payload, failed = undone(body, source, most)
    charset = (re.search(r"charset=\"?([\w-]+)", kind, re.I) or ["", "utf-8"])[1]
    links: list[str] = []
    text = None
    if content is not None and kind.lower().startswith(("text/html", "application/xhtml")):
        try:
            page = content.decode(charset, "replace")
        except (LookupError, UnicodeError):
            page = content.decode("utf-8", "replace")
        text = "\n".join(b.text for b in blocks(page, links)).encode("utf-8", "replace")
    fields = [("status", status), *((f"http-{k}", v) for k, v in source), ("payload-digest-declared", declared), ("payload-digest-computed", digest(payload))]
    fields += [("decoding", failed)] * bool(failed) + [("outlink", x) for x in links]
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)
    made = [("metadata", "application/warc-fields", lines.encode("utf-8", "replace"))]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text))
    out = []
    for kind, content_type, content in made:
        own = record_id(kind, origin, digest(content))
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("Content-Type", content_type), ("WARC-Block-Digest", digest(content)),
        ]
        if kind == "conversion":
            headers.append(("WARC-Source-Payload-Digest", declared))
        out.append({
            "record_type": kind, "record_id": own, "refers_to": origin, "target_uri": uri, "date": date, "content_type": content_type,
            "content_length": len(content), "block_digest": digest(content), "source_block_digest": first(head, "warc-block-digest"),
            "source_payload_digest": declared, "source_headers": [{"name": k, "value": v} for k, v in source],
            "record": write_record(headers, content, packed),
        })
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A row (page_id null, source: the file, record) for each record of the archive files below a path. A task holds one file at a time (2 GB at most,
    Spark's limit for a binary file)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some, size = [], 0
                for record in split_records(data.as_py()):
                    some.append(record)
                    size += len(record)
                    if size > ROWS_BYTES:
                        yield rows(name, some)
                        some, size = [], 0
                yield rows(name, some)

    def rows(name: str, some: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array([name] * len(some), pa.string()), pa.array(some, pa.binary())], ["page_id", "source", "record"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, RECORDS)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """A response record for each page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, u, p in zip(*batch.columns, strict=True):
                i, u = i.as_py(), u.as_py()
                rows.append((i, u, response(i, u, p.as_py(), date)))
                size += len(rows[-1][2])
                if size > ROWS_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["page_id", "source", "record"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("source"), F.col(page).alias("html")).mapInArrow(run, RECORDS)


def derive(records: DataFrame, packed: bool = False, max_body: int = 0) -> DataFrame:
    """The derivative records of response records (page_id, source, record). max_body: bytes that a body may have without its encodings; 0: any number."""
    names = [x.split()[0] for x in DERIVED.split(", ")]
    pair = pa.struct([("name", pa.string()), ("value", pa.string())])
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.list_(pair), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, r in zip(*batch.columns, strict=True):
                i = i.as_py()
                for d in derivatives(r.as_py() or b"", packed, max_body):
                    rows.append({"page_id": i} | d)
                    size += len(d.get("record") or b"")
                if size > ROWS_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return records.select("page_id", "record").mapInArrow(run, DERIVED)
