"""WARC writing with revisit records, and a reader that salvages what is left of damaged archives.

An archive is a row ``(path, content)``, as Spark's ``binaryFile`` source gives it, so archives lie in any store that
Spark reaches; each record is a gzip member of its own. The reader checks every record (version line, headers, lengths,
block digest) and every member. Where a check fails it searches for the next gzip member or version line from which a
whole record can be read, goes on there and reports the bytes in between as a gap. Members may hold any number of
records: these are read while the member is decompressed, the search goes on among its decompressed bytes, and what came
before a fault of the member itself is kept.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import cut, small_batches

REVISIT_FROM = 1000  # payload bytes
ARCHIVE_BYTES = 4 << 20
BROADCAST_ROWS = 100_000  # of (20-byte digest, id): at most a few MB
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

RECORD = "path string, kind string, offset long, length long, reason string, inner_offset long, inner_length long, record_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class Damaged(Exception):
    """A check on a record failed."""


class Short(Damaged):
    """The data ends before a record does."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record_bytes(page: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One uncompressed record; with ``refers_to`` a revisit, whose block keeps the HTTP headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {quote(uri, safe='%:/?#[]@!$&()*+,;=~-._')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("header line")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
VERSION_BYTES = 10
HEAD_BYTES = 1 << 20  # headers end before


def parse_record(data: bytes | bytearray, at: int = 0) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the record at ``at``; raises Damaged where a check fails, Short if it goes on beyond the data."""
    if not VERSION.match(data, at):
        start = bytes(data[at : at + VERSION_BYTES])
        whole = len(start) == VERSION_BYTES or not any(v.startswith(start) for v in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"))
        raise (Damaged if whole else Short)("version line")
    stop = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if stop < 0:
        raise (Damaged if len(data) >= at + HEAD_BYTES else Short)("headers end")
    head = _headers(bytes(data[at:stop]).split(b"\r\n")[1:])
    size = head.get("content-length", "")
    if not size.isdecimal() or not head.get("warc-type") or not head.get("warc-record-id"):
        raise Damaged("headers")
    end = stop + 4 + int(size)
    if len(data) < end + 4:
        raise Short("length")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = bytes(data[stop + 4 : end])
    if (said := head.get("warc-block-digest", "")).startswith("sha1:") and said != _digest(block):
        raise Damaged("block digest")
    return end + 4, head, block


class _Member:
    """The gzip member at ``at``: its decompressed pieces, then where it ends and what is wrong with it, if anything."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.end, self.fault = data, at, ""

    def pieces(self) -> Iterator[bytes]:
        unpack, rest = zlib.decompressobj(31), b""
        while not unpack.eof:
            if not rest:
                if self.end >= len(self.data):
                    self.fault = "member cut off"
                    return
                rest = bytes(self.data[self.end : self.end + STEP])
                self.end += len(rest)
            before = unpack.copy()
            try:
                piece = unpack.decompress(rest, STEP)
                rest = unpack.unconsumed_tail
                yield piece
            except zlib.error:
                self.fault = "member"
                yield b"".join(_until_fault(before, rest))
                return
        self.end -= len(unpack.unused_data)


def _until_fault(unpack, data: bytes) -> Iterator[bytes]:
    try:
        for i in range(len(data)):
            yield unpack.decompress(data[i : i + 1])
    except zlib.error:
        return


def _inside(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason) of what a member decompresses to.

    Bytes are let go once they are read, so that one record is held, and what its length makes it wait for.
    """
    data, start, bad, reason, ended = bytearray(), 0, -1, "", False
    while True:
        try:
            end, head, block = parse_record(data)
            if bad >= 0:
                yield "gap", bad, start - bad, reason
                bad = -1
            yield "record", start, end, head, block
            del data[:end]
            start += end
            continue
        except Damaged as e:
            if isinstance(e, Short) and not ended:
                piece = next(pieces, None)
                ended = piece is None
                data += piece or b""
                continue
            if ended and not data:
                break
            if bad < 0:
                bad, reason = start, str(e)
        found = VERSION.search(data, 1)
        while not found and not ended:
            piece = next(pieces, None)
            ended = piece is None
            drop = max(0, len(data) - VERSION_BYTES)
            del data[:drop]
            start += drop
            data += piece or b""
            found = VERSION.search(data, 1 if not drop else 0)
        skip = found.start() if found else len(data)
        del data[:skip]
        start += skip
    if bad >= 0:
        yield "gap", bad, start - bad, reason


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block, inner offset, inner length) for each whole record, ("gap", offset, length,
    reason, inner offset, inner length) for the rest.

    Empty data gives nothing. Offsets and lengths are bytes of ``data``; together they cover it without overlap. Those
    inside a gzip member are of its decompressed bytes (else null): its last row has its length in ``data``, the others 0.
    What a damaged member gave before its fault stands before the gap that it is part of, but for the last record where
    the member's checksum or coding fails: nothing says that it lies before the fault.
    """
    view, at, bad, reason = memoryview(data), 0, -1, ""
    start = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
    while at < len(data):
        fault, end, some = "", at, False
        if data[at : at + 2] == b"\x1f\x8b":
            member, waiting = _Member(view, at), []  # events from the last record on
            for kind, offset, length, *more in _inside(member.pieces()):
                if kind == "record" and any(x[0] == "record" for x in waiting):
                    if bad >= 0:
                        yield "gap", bad, at - bad, reason, None, None
                        bad = -1
                    yield from waiting
                    waiting, some = [], True
                waiting.append((kind, at, 0, *more, offset, length))
            end = member.end
            if member.fault == "member":
                # where the fault lies isn't known any better than to the last record that looked whole
                waiting = []
            some = some or any(x[0] == "record" for x in waiting)
            fault = member.fault or ("" if some else "no record")
            if some and waiting:
                if bad >= 0:
                    yield "gap", bad, at - bad, reason, None, None
                    bad = -1
                if not fault:
                    waiting[-1] = (*waiting[-1][:2], end - at, *waiting[-1][3:])
                yield from waiting
        else:
            try:
                end, head, block = parse_record(data, at)
                if bad >= 0:
                    yield "gap", bad, at - bad, reason, None, None
                    bad = -1
                yield "record", at, end - at, head, block, None, None
            except Damaged as e:
                fault = str(e)
        if not fault:
            at = end
            continue
        if bad < 0:
            bad, reason = at, fault
        following = start.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad >= 0:
        yield "gap", bad, len(data) - bad, reason, None, None


def _payload(head: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Full payload size, and the payload where the record holds it."""
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        return len(block), block
    if head["warc-type"] == "revisit":
        size = _headers(block[:stop].split(b"\r\n")[1:]).get("content-length", "0")
        return int(size), None
    return len(block) - stop - 4, block[stop + 4 :]


def revisits(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """``pages`` with ``refers_to``: null for responses, else the id of the response with the same payload.

    Of equal payloads of at least ``least`` bytes the one with the largest id is the response (rows that share that id
    and payload all are); payloads whose ids are all null are responses. Null html is an empty payload.
    """
    key, payload = "__payload_sha1", F.coalesce(F.col(html), F.lit("")).cast("binary")
    keyed = pages.drop("refers_to").withColumn(key, F.when(F.octet_length(payload) >= least, F.sha1(payload)))
    kept = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max(id).alias("__kept"))
    kept = cut(kept.where("__n > 1 and __kept is not null").select(key, "__kept"))
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    refers = F.when(F.col(id).isNull() | (F.col(id) < F.col("__kept")), F.col("__kept"))
    return keyed.join(kept, key, "left").withColumn("refers_to", refers).drop(key, "__kept")


def write_archives(pages: DataFrame, id: str = "page_id", uri: str = "url", html: str = "html", size: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``(path, content)`` with a record for each row of ``pages`` (with ``refers_to`` of ``revisits``).

    An archive ends after the record that reaches ``size`` bytes. An empty table gives no archive; url may be null;
    repeated rows give repeated records. Extra columns are not read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, members = TaskContext.get(), 0, 0, []
        names = ["path", "content"]

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task.partitionId():05d}-{n:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=names)

        for batch in batches:
            for page, url, body, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members.append(gzip_member(record_bytes(page, url, (body or "").encode(), refers)))
                held += len(members[-1])
                if held >= size:
                    yield full()
                    n, held, members = n + 1, 0, []
        if members:
            yield full()

    return pages.select(id, uri, html, "refers_to").mapInArrow(run, "path string, content binary")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of ``archives`` (path, content): kind is "record" or "gap"; null content is read as empty.

    payload_bytes and payload_digest (lower-case hex) are of the full payload; a revisit has no payload of its own, and
    with ``payloads`` false no row has one. Offsets and lengths as ``salvage`` gives them. An archive is held whole, its
    members are decompressed bit by bit; repeated rows are read each; an empty table gives no rows. Columns besides path
    and content are not read.
    """
    small_batches(archives.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        for kind, offset, length, *more in salvage(content):
            if kind == "gap":
                yield path, kind, offset, length, *more, *[None] * 7
                continue
            head, block, *inner = more
            size, payload = _payload(head, block)
            said = head.get("warc-payload-digest", "").removeprefix("sha1:")
            digest = base64.b32decode(said).hex() if re.fullmatch("[A-Z2-7]{32}", said) else None
            wrong = payload is not None and digest is not None and hashlib.sha1(payload).hexdigest() != digest
            yield path, "gap" if wrong else kind, offset, length, "payload digest" if wrong else None, *inner, head["warc-record-id"], head.get("warc-target-uri"), head["warc-type"], head.get("warc-refers-to"), size, digest, payload if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found, held = [], 0
                for row in rows(path.as_py(), content.as_py() or b""):
                    found.append(row)
                    held += len(row[-1] or b"")
                    if held >= ARCHIVE_BYTES:
                        yield _batch(found, names)
                        found, held = [], 0
                if found:
                    yield _batch(found, names)

    return archives.select("path", "content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files (``.warc``, ``.warc.gz``) under ``path``, from any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive to ``folder``, a mounted path that driver and executors share; a retried task replaces its files."""

    def run(rows) -> None:
        for row in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, os.path.join(folder, row.path))

    os.makedirs(folder, exist_ok=True)
    archives.foreachPartition(run)


def page_records(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, read them back and return a row for each record read.

    Null html is an empty payload; repeated rows are records each, of which those with the largest id are responses; a
    page is one record, however long; an empty table gives no rows. Other columns are not read.
    """
    archives = cut(write_archives(revisits(pages)))
    found = read_archives(archives, payloads=False).where("kind = 'record'")
    page = lambda c: F.try_to_number(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("S" + "9" * 19)).cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
