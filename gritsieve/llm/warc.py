"""Operator 6: WARC salvage reader (and the writer that its round trips use).

A record counts if it passes every check: an intact gzip member (with its CRC) where compressed, a version line, well-formed
headers, a block as long as ``Content-Length`` says, the two closing line breaks, and the block digest where one is given.
After a failed check the reader opens a gap, searches for the next gzip magic or version line, tries there, and goes on until
a record passes, so later records are recovered; the bytes passed over are logged as one ``gap`` with its first failure and
the id of the record that ends it. An intact member may hold several records; the same salvage applies to its content.

Scale: archives are the unit of work, read through a seekable file, so tasks follow archives and no archive is shuffled.
Nothing is held but the record that is read: headers are checked line by line, what a false length points at is checked
before the block is read, and a member of more than ``HELD`` bytes is inflated once to check it and once more, piece by
piece, to read it. Defined cases: null and empty archives give nothing; an archive without a valid record is one gap; records
and headers of any length are read whole; repeated archives report each; a header that is absent is null; of repeated headers
the last counts; an empty table gives an empty result; pages with null html have no record; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import need

STEP = 1 << 16
#: Bytes of a member's content that are kept from the check for the reading.
HELD = 16 << 20
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]+\r?\n")
_VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]+\r?\n")
_NAME = re.compile(rb"[^\x00-\x20\x7f:]+[ \t]*:")
#: A header line into which the version line of another record has run.
_TORN_LINE = re.compile(rb"WARC/[0-9]\.[0-9]+$")
_LONGEST_START = 16


class Damaged(Exception):
    """A failed check; its text names it."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    end: int


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class _Source:
    """Random reads of a seekable file, with the last piece kept."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, io.SEEK_END)
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.fetch(at, max(n, STEP))
        return self.held[at - self.at : at - self.at + n]

    def fetch(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def line(self, at: int, cut: re.Pattern | None = None) -> bytes:
        """The bytes from ``at`` through the next line feed; none if what begins there doesn't match ``cut`` or has no end."""
        n = 256
        while True:
            piece = self.read(at, n)
            if cut and not cut.match(piece) and (b"\n" in piece or b":" in piece or len(piece) >= 256):
                return b""
            stop = piece.find(b"\n")
            if stop >= 0:
                return piece[: stop + 1]
            if len(piece) < n:
                return b""
            n *= 4

    def find(self, at: int, start: re.Pattern = _START) -> int:
        """The next place from ``at`` where a member or record may start; the size if there is none."""
        while at < self.size:
            piece = self.read(at, STEP)
            found = start.search(piece)
            if found:
                return at + found.start()
            if at + len(piece) >= self.size:
                break
            at += len(piece) - _LONGEST_START
        return self.size


class _Inflated(_Source):
    """The content of the intact member at ``place`` of a source, inflated anew from its start when read backwards."""

    def __init__(self, source: _Source, place: int, size: int):
        self.source, self.place, self.size = source, place, size
        self.at, self.held = 0, b""
        self._restart()

    def _restart(self) -> None:
        self.pack, self.next, self.done, self.spare = zlib.decompressobj(31), self.place, 0, b""

    def fetch(self, at: int, n: int) -> bytes:
        if at < self.done - len(self.spare):
            self._restart()
        out, have = [self.spare], len(self.spare)
        begin = self.done - have
        while begin + have < at + n and not self.pack.eof:
            piece = self.pack.unconsumed_tail
            if not piece:
                piece = self.source.fetch(self.next, STEP)
                self.next += len(piece)
            more = self.pack.decompress(piece, STEP)
            self.done += len(more)
            if begin + have <= at and have > 4 * STEP:  # what lies before isn't asked for
                out, begin, have = out[-1:], self.done - len(more) - len(out[-1]), len(out[-1])
            out.append(more)
            have += len(more)
        whole = b"".join(out)
        self.spare = whole[-STEP:]
        return whole[at - begin : at - begin + n]


class _Held(_Source):
    def __init__(self, content: bytes):
        super().__init__(io.BytesIO(content))


def _record(source: _Source, at: int) -> Record:
    """The record at ``at``; raises Damaged."""
    version = source.line(at, _VERSION_LINE)
    if not version:
        raise Damaged("version")
    headers: dict[str, str] = {}
    place = at + len(version)
    while True:
        if source.read(place, 2)[:1] == b"\n" or source.read(place, 2) == b"\r\n":
            place += 1 if source.read(place, 1) == b"\n" else 2
            break
        line = source.line(place, _NAME)
        if not line or _TORN_LINE.search(line.rstrip(b"\r\n")):
            raise Damaged("headers")
        name, _, value = line.partition(b":")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        place += len(line)
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damaged("length")
    stop = place + int(size)
    if stop > source.size:
        raise Damaged("truncated")
    closing = re.match(rb"\r\n\r\n|\n\n", source.read(stop, 4))
    if not closing:
        raise Damaged("closing")
    block = source.fetch(place, stop - place)
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() in ("sha1", "sha256", "md5"):
        own = hashlib.new(kind.lower(), block)
        if digest.lower() not in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower()):
            raise Damaged("digest")
    return Record(headers, block, at, stop + closing.end())


def _member(source: _Source, at: int) -> tuple[_Source, int]:
    """Content and end of the gzip member at ``at``, after its CRC has been checked."""
    unpack, kept, size, place = zlib.decompressobj(31), [], 0, at
    while not unpack.eof:
        piece = unpack.unconsumed_tail
        if not piece:
            piece = source.fetch(place, STEP)
            place += len(piece)
        try:
            more = unpack.decompress(piece, STEP)
        except zlib.error:
            raise Damaged("gzip") from None
        if not piece and not more:
            raise Damaged("truncated member")
        size += len(more)
        if size <= HELD:
            kept.append(more)
        else:
            kept = []
    end = place - len(unpack.unused_data)
    return (_Held(b"".join(kept)) if size <= HELD else _Inflated(source, at, size)), end


def salvage(file) -> Iterator[Record | Gap]:
    """Records and gaps of a seekable binary file, in order. Places of records inside a member are the member's."""
    yield from _salvage(_Source(file), True)


def _salvage(source: _Source, members: bool) -> Iterator[Record | Gap]:
    at, gap, why = 0, None, ""
    while at < source.size:
        try:
            if members and source.read(at, 2) == b"\x1f\x8b":
                content, end = _member(source, at)
                if not content.size:
                    raise Damaged("empty member")
                found = _moved(content, at, end)
                first = next(found)  # a gap only if no record follows in the member
                if isinstance(first, Gap):
                    raise Damaged(first.reason)
            else:
                first, found = _record(source, at), iter(())
                end = first.end
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = source.find(at + 1, _START if members else _VERSION_LINE)
            continue
        if gap is not None:
            yield Gap(gap, at, why)
            gap = None
        yield from _unwrapped(first)
        for x in found:
            yield from _unwrapped(x)
        at = end
    if gap is not None:
        yield Gap(gap, source.size, why)


def _unwrapped(x: Record | Gap | list) -> list[Record | Gap]:
    return x if isinstance(x, list) else [x]


def _moved(content: _Source, at: int, end: int) -> Iterator[list[Record | Gap] | Gap]:
    """Lists of a member's records and gaps, each with the member's place, the first list up to its first record; one bare gap if it has none."""
    held: list[Record | Gap] = []
    any_record = False
    for x in _salvage(content, False):
        if isinstance(x, Record):
            any_record = True
            yield [*held, Record(x.headers, x.block, at, end)]
            held = []
        else:
            held.append(Gap(at, end, f"in member: {x.reason}"))
    if not any_record:
        yield Gap(at, end, held[0].reason.removeprefix("in member: "))
    elif held:
        yield held


def record_bytes(block: bytes, url: str | None = None, extra: dict[str, str] | None = None, compress: bool = True) -> bytes:
    """One resource record, as a gzip member or plain."""
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:sha1:{hashlib.sha1(block + (url or '').encode()).hexdigest()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url)
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    lines += ["Content-Type: text/html", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    if not compress:
        return raw
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


SCHEMA = "kind string, id string, url string, block binary, start long, end long, reason string, resumed string"
_NAMES = ["kind", "id", "url", "block", "start", "end", "reason", "resumed"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _rows(file) -> Iterator[tuple]:
    """Rows of SCHEMA; a gap waits for the record that ends it."""
    gaps: list[Gap] = []
    for x in salvage(file):
        if isinstance(x, Gap):
            gaps.append(x)
            continue
        own = x.headers.get("x-page-id")
        yield from (("gap", None, None, None, g.start, g.end, g.reason, own) for g in gaps)
        gaps.clear()
        yield "record", own, x.headers.get("warc-target-uri"), x.block, x.start, x.end, None, None
    yield from (("gap", None, None, None, g.start, g.end, g.reason, None) for g in gaps)


def _batches(archives: Iterator[tuple[str | None, object]]) -> Iterator[pa.RecordBatch]:
    names, rows, held = [], [], 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]], names=["archive", *_NAMES])

    for name, file in archives:
        for row in _rows(file):
            names.append(name)
            rows.append(row)
            held += len(row[3] or b"")
            if held > 8 << 20 or len(rows) >= 5000:
                yield flush()
                names, rows, held = [], [], 0
    if rows:
        yield flush()


def read_contents(archives: DataFrame) -> DataFrame:
    """(archive, *SCHEMA) rows of (archive, content) rows that hold whole archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((n, io.BytesIO(c)) for b in batches for n, c in zip(b["archive"].to_pylist(), b["content"].to_pylist(), strict=True) if c)

    return need(archives, "archive", "content").select(F.col("archive").cast("string").alias("archive"), "content").mapInArrow(run, f"archive string, {SCHEMA}")


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, *SCHEMA) rows of archive files of any file system that pyarrow knows, one task for each file."""

    def opened(path: str):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        return system.open_input_file(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((p, opened(p)) for b in batches for p in b["archive"].to_pylist())

    table = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "at int, archive string")
    if paths:
        table = table.repartitionByRange(len(paths), "at")
    return table.select("archive").mapInArrow(run, f"archive string, {SCHEMA}")


#: Pages of an archive that :func:`pack_pages` writes, and bytes of them from which it is full.
PAGES, FULL = 64, 8 << 20
#: Bytes of a torn record that are left of it, and of a torn member.
TORN_RECORD, TORN_MEMBER = 60, 8


def stored_member(raw: bytes) -> bytes:
    """A gzip member that holds ``raw`` uncompressed; 18 bytes, and 5 for each 65,535, are added."""
    parts = [b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"]
    for a in range(0, len(raw), 65_535):
        piece = raw[a : a + 65_535]
        parts += [struct.pack("<BHH", a + 65_535 >= len(raw), len(piece), len(piece) ^ 0xFFFF), piece]
    return b"".join([*parts, struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)])


def _hurt(number: int, plain: bytes) -> bytes:
    """A damaged copy of a record, of the kind that its number modulo 8 names (none for 0 and 7)."""
    kind = number % 8
    if kind == 1:  # torn while its headers were written
        return plain[:TORN_RECORD]
    if kind == 2:  # a member torn in its header
        return stored_member(plain)[:TORN_MEMBER]
    if kind == 3:  # a member with a wrong CRC (and no version line that a search could find in it)
        whole = stored_member(plain[8:])
        return whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    if kind == 4:  # a block that its digest denies
        return re.sub(rb"(WARC-Block-Digest: sha1:)(.)", lambda m: m[1] + (b"B" if m[2] == b"A" else b"A"), plain, count=1)
    if kind == 5:  # a length that points past the closing line breaks
        return re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %0*d" % (len(m[1]), int(m[1]) + 1), plain, count=1)
    if kind == 6:  # bytes of no format
        return b"torn bytes of another write "
    return b""


def pack_pages(pages: DataFrame) -> DataFrame:
    """(archive, content): the pages in archives of up to PAGES, in members and plain by turns, each behind a damaged copy by its id."""

    def archive(rows: list[tuple]) -> bytes:
        out = []
        for i, u, h in rows:
            url, extra = u and re.sub(r"[\r\n]+", " ", u), {} if i is None else {"X-Page-Id": str(i)}
            if i is not None:
                out.append(_hurt(i, record_bytes(h.encode(), url, extra, False)))
            out.append(record_bytes(h.encode(), url, extra, i is None or i % 2 == 0))
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for row in zip(*[b[c].to_pylist() for c in ("page_id", "url", "html")], strict=True):
                rows.append(row)
                held += len(row[2])
                if len(rows) >= PAGES or held >= FULL:
                    yield pa.RecordBatch.from_arrays([pa.array([str(rows[0][0])]), pa.array([archive(rows)], pa.binary())], names=["archive", "content"])
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([str(rows[0][0])]), pa.array([archive(rows)], pa.binary())], names=["archive", "content"])

    return need(pages, "page_id", "url", "html").where(F.col("html").isNotNull()).mapInArrow(run, "archive string, content binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """(kind, page_id, url, n_bytes, sha256, reason): what the salvage reader finds in the pages' archives.

    Of a gap, ``page_id`` is that of the record that ended it and ``n_bytes`` the bytes passed over.
    """
    found = read_contents(pack_pages(pages))
    gap = F.col("kind") == "gap"
    return found.select(
        "kind", F.when(gap, F.col("resumed")).otherwise(F.col("id")).cast("long").alias("page_id"), "url",
        F.when(gap, F.col("end") - F.col("start")).otherwise(F.octet_length("block")).cast("long").alias("n_bytes"), F.sha2("block", 256).alias("sha256"), "reason",
    )


_PLAIN = "(SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, 240 + octet_length(encode('WARC-Target-URI: ' || url || 'X-Page-Id: ' || page_id || chr(13) || chr(10) || chr(13) || chr(10))) + octet_length(encode(html)) + len(CAST(octet_length(encode(html)) AS VARCHAR)) AS size FROM pages WHERE html IS NOT NULL)"
SQL = f"""
SELECT 'record' AS kind, page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, sha256(html) AS sha256, CAST(NULL AS VARCHAR) AS reason FROM pages WHERE html IS NOT NULL
UNION ALL
SELECT 'gap', page_id, NULL, CAST(CASE page_id % 8 WHEN 1 THEN {TORN_RECORD} WHEN 2 THEN {TORN_MEMBER} WHEN 3 THEN size + 10 + 5 * ((size - 8 + 65534) // 65535) WHEN 6 THEN 28 ELSE size END AS BIGINT), NULL,
  CASE page_id % 8 WHEN 1 THEN 'headers' WHEN 2 THEN 'gzip' WHEN 3 THEN 'gzip' WHEN 4 THEN 'digest' WHEN 5 THEN 'closing' ELSE 'version' END FROM {_PLAIN} WHERE page_id % 8 BETWEEN 1 AND 6
"""


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
