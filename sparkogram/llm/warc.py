"""WARC archives: writing pages and reading archives back with salvage.

Writing: every page becomes a record in its own gzip member.  Pages with equal
payloads refer to the one with the smallest id; which one that is, is decided on
digests alone, so a payload that a third of all pages share moves as small rows.

Reading: members are decoded one at a time from any offset.  When a check fails
(gzip data or checksum, version line, header, length, block or payload digest),
the reader searches for the next member magic or version line that decodes,
goes on there, and logs the bytes between as a quarantined gap.  Inside a member
the search goes over the decoded bytes, up to the damage if the gzip data fail.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.llm.textops import pieces, tidy
from sparkogram.runtime import cut, scratch_path

_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK, _PIECE = 1 << 18, 1 << 20
#: Decoded bytes of a member kept in memory; larger members go through a temporary file.
_HELD = 32 << 20
#: Payload bytes that a row can hold.
_VALUE = (1 << 31) - (1 << 16)


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def base32_sha1(data: bytes) -> str:
    return _base32(hashlib.sha1(data))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a plain path or a URI (file, hdfs, s3, ...)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(kind: str, name: str, block: bytes, headers: list[tuple[str, str]], date: str) -> bytes:
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        *headers,
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit when ``refers_to`` names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if refers_to is None:
        return record("response", f"urn:x-page:{page_id}", http + payload, headers, date)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return record("revisit", f"urn:x-page:{page_id}", http, headers, date)


def write_batches(folder: str, max_bytes: int, level: int, date: str):
    """mapInArrow function: (page_id, url, html, source) to a manifest row per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        # a new name for every attempt: only archives named in the manifest count
        stem, number, out, size, count = uuid.uuid4().hex, 0, None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            row = [[f"{folder}/{stem}-{number:05d}.warc.gz"], [count], [size]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["archive", "records", "bytes"])

        for batch in pieces(batches, 2):
            for page, url, html, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, size, count = system.open_output_stream(f"{base}/{stem}-{number:05d}.warc.gz", compression=None), 0, 0
                other = source if source is not None and source != page else None
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(page_record(page, url, (html or "").encode(), other, date)) + pack.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= max_bytes:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    max_bytes: int = 64 << 20,
    level: int = 4,
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write page_id, url, html as archives below ``folder``; returns the manifest (archive, records, bytes).

    Of pages whose payloads (UTF-8, null as empty) are equal and have at least
    ``min_bytes`` bytes, the smallest page_id is the response and others revisit
    it; repeated rows of that very page are all responses.  Runs at once.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    src = src.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    small = F.octet_length(F.coalesce("html", F.lit(""))) < min_bytes
    keys = src.select("page_id", "sha", small.alias("small"))
    # written before it is joined back: then adaptive execution can split a payload that very many pages share
    first = cut(keys.where("not small").groupBy("sha").agg(F.min("page_id").alias("source")), "first")
    roles = keys.where("not small and page_id is not null").join(first, "sha").where("page_id <> source").distinct()
    rows = src.join(roles.select("page_id", "sha", "source"), ["page_id", "sha"], "left").select("page_id", "url", "html", "source")
    return cut(rows.mapInArrow(tidy(write_batches(folder, max_bytes, level, date)), "archive string, records long, bytes long"), "manifest")


class Damaged(ValueError):
    pass


class Block(NamedTuple):
    """Where a record's block lies: its head (up to the first empty line) and its payload are read when asked for."""

    read: Callable[[int, int], bytes]
    start: int
    split: int  # end of the head
    body: int  # begin of the payload
    end: int
    payload_sha1: str | None  # known when it was checked or the headers give no digest
    vouched: bool  # a digest of the block or payload was there and held
    doubt: str | None = None  # what failed in its member
    inner: tuple[int, int] | None = None  # [first, end) of the record in its member's decoded bytes

    @property
    def payload_bytes(self) -> int:
        return self.end - self.body

    def head(self) -> bytes:
        return self.read(self.start, self.split - self.start)

    def payload(self) -> bytes:
        return self.read(self.body, self.end - self.body)


def _find(read, what: bytes, at: int, size: int) -> int:
    """The first offset of ``what`` from ``at`` on, or -1; holds a piece at a time."""
    step = 1 << 12
    while at < size:
        data = read(at, step)
        i = data.find(what)
        if i >= 0:
            return at + i
        if len(data) < step:
            break
        at += len(data) - len(what) + 1
        step = min(4 * step, _CHUNK)
    return -1


def parse_record(read, at: int, size: int) -> tuple[dict[str, str], Block, int]:
    """(headers, block, end) of the record at an offset of ``size`` bytes; every check that its headers allow.

    The block passes through its digests in pieces, so a record may have any size.
    """
    if read(at, len(_VERSION)) != _VERSION:
        raise Damaged("no version line")
    end = _find(read, b"\r\n\r\n", at, size)
    if end < 0:
        raise Damaged("header without end")
    try:
        lines = read(at, end - at).decode().split("\r\n")[1:]
    except UnicodeDecodeError as e:
        raise Damaged("header is no text") from e
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 20):
        raise Damaged("no length")
    start = end + 4
    stop = start + int(length)
    if stop > size:
        raise Damaged("block is cut off")
    if read(stop, 4) != b"\r\n\r\n":
        raise Damaged("record without end")
    want = [headers.get(f"warc-{x}-digest", "") for x in ("block", "payload")]
    whole = hashlib.sha1() if want[0].startswith("sha1:") else None
    check = headers.get("warc-type") == "response" and want[1].startswith("sha1:")
    part = hashlib.sha1() if check or not want[1].removeprefix("sha1:") else None
    split, body, tail, pos = stop, stop, b"", start
    while pos < stop:
        data = read(pos, min(_PIECE, stop - pos))
        if not data:
            raise Damaged("block is cut off")
        if whole:
            whole.update(data)
        begin = 0
        if body == stop:
            near = tail + data
            i = near.find(b"\r\n\r\n")
            begin = i + 4 - len(tail) if i >= 0 else len(data)
            if i >= 0:
                split, body = pos - len(tail) + i, pos + begin
            tail = near[-3:]
        if part:
            part.update(memoryview(data)[begin:])
        pos += len(data)
    if whole and want[0][5:] != _base32(whole):
        raise Damaged("block digest differs")
    if check and want[1][5:] != _base32(part):
        raise Damaged("payload digest differs")
    return headers, Block(read, start, split, body, stop, part and _base32(part), bool(whole or check)), stop + 4


class Gap(NamedTuple):
    """Quarantined bytes: of the archive, or, where its member gave records, of the member's decoded bytes."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


class Salvage:
    """Iterates over the records of an archive of ``size`` bytes; ``gaps`` gets what is in no record.

    Of a damaged member the records that are whole are yielded all the same: those
    before a cut-off, and, when its data or checksum fail, those of several that a
    digest vouches for.  No digest covers headers, so the block of such a record
    names what failed as its ``doubt``.  The gaps of such a member are the ranges of
    its decoded bytes between its records; a member without any is one gap.
    """

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.gaps: list[Gap] = []

    def _member(self, at: int, out) -> tuple[int, str | None]:
        """Writes the decoded member to a file; (where decoding ended, what failed)."""
        unpack, pos, left = zlib.decompressobj(31), at, b""
        first = True
        while not unpack.eof:
            if not left:
                left = self.read_at(pos, _CHUNK)
                pos += len(left)
            last, before = not left, None if first else unpack.copy()
            try:
                data = unpack.decompress(left, _PIECE)
            except zlib.error as e:
                # the failed call keeps its output: byte by byte up to the damage
                unpack, i = before or zlib.decompressobj(31), 0
                try:
                    while i < len(left):
                        out.write(unpack.decompress(left[i : i + 1]))
                        i += 1
                except zlib.error:
                    pass
                return pos - len(left) + i, f"gzip: {e}"
            out.write(data)
            if last and not data and not unpack.eof:
                return pos, "member is cut off"
            left, first = unpack.unconsumed_tail, False
        return pos - len(unpack.unused_data), None

    def _reach(self, at: int, size: int) -> int:
        """The offset up to which a member is read for its first ``size`` decoded bytes."""
        unpack, pos, left = zlib.decompressobj(31), at, b""
        while size > 0:
            if not left:
                left = self.read_at(pos, _CHUNK)
                pos += len(left)
            size -= len(unpack.decompress(left, min(size, _PIECE)))
            left = unpack.unconsumed_tail
        return pos - len(left)

    def _next(self, at: int) -> int:
        """The next offset where a member or a version line may begin."""
        while at < self.size:
            data = self.read_at(at, _CHUNK)
            found = [i for i in (data.find(_MAGIC), data.find(_VERSION)) if i >= 0]
            if found:
                return at + min(found)
            if len(data) < _CHUNK:
                break
            at += len(data) - len(_VERSION) + 1
        return self.size

    def _gap(self, start: int, end: int, reason: str) -> None:
        old = self.gaps[-1] if self.gaps else None
        if old and old.end == start and old.inner is None:
            self.gaps[-1] = old._replace(end=end)
        else:
            self.gaps.append(Gap(start, end, reason))

    def _records(self, at: int) -> Iterator[tuple[int, int, dict[str, str], Block]]:
        """The records of the member at an offset; returns where to go on."""
        with tempfile.SpooledTemporaryFile(max_size=_HELD) as file:

            def read(i: int, n: int) -> bytes:
                file.seek(i)
                return file.read(n)

            end, torn = self._member(at, file)
            size, pos, sound, why = file.seek(0, os.SEEK_END), 0, 0, torn
            holes: list[tuple[int, int, str]] = []
            while 0 <= pos < size:
                try:
                    headers, block, after = parse_record(read, pos, size)
                    if torn and torn.startswith("gzip") and (not block.vouched or (pos, after) == (0, size)):
                        raise Damaged("nothing vouches for it")
                except Damaged as e:
                    why = why or str(e)
                    pos = _find(read, _VERSION, pos + 1, size)
                    continue
                if pos > sound:
                    holes.append((sound, pos, why or "no version line"))
                yield at, end, headers, block._replace(doubt=torn, inner=(pos, after))
                pos = sound = after
        if why and sound < size:
            holes.append((sound, size, why))
        if torn:  # a decoder may run on into later members, but not before the end of a sound record
            end = self._next(max(at + 1, self._reach(at, sound - 1)))
        if why and sound:
            self.gaps += [Gap(at, end, reason, (a, b)) for a, b, reason in holes or [(size, size, why)]]
        elif why:
            self._gap(at, end, why)
        return end

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], Block]]:
        """(offset, end, headers, block) of every record that passes its checks; read a block before the next record."""
        at = 0
        while at < self.size:
            head = self.read_at(at, len(_VERSION))
            if head.startswith(_MAGIC):
                at = yield from self._records(at)
                continue
            try:
                if head != _VERSION:
                    raise Damaged("no member or version line")
                headers, block, end = parse_record(self.read_at, at, self.size)
            except Damaged as e:
                end = self._next(at + 1)
                self._gap(at, end, str(e))
            else:
                yield at, end, headers, block
            at = end


#: Tasks of one reading job at most; beyond that many archives a task reads several.
MAX_TASKS = 50_000

READ = (
    "archive string, offset long, end long, inner_offset long, inner_end long, kind string, record_type string, record_id string, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to string, reason string, payload binary"
)


def read_batches(payloads: bool):
    """mapInArrow function: (archive) to READ rows, a row per record and per gap."""
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 4, pa.int64(), *[pa.string()] * 3, pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _place(archive)
                with system.open_input_file(path) as f:
                    size = f.size()
                    salvage = Salvage(lambda at, n, f=f, size=size: f.read_at(max(0, min(n, size - at)), at), size)
                    rows, held = [], 0
                    for at, end, h, block in salvage:
                        n = block.payload_bytes
                        if h.get("warc-type") == "revisit":
                            sizes = [x.partition(b":")[2] for x in block.head().split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            n = int(sizes[0]) if sizes else None
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or block.payload_sha1
                        payload = block.payload() if payloads and block.payload_bytes <= _VALUE else None
                        rows.append(
                            (archive, at, end, *(block.inner or (None, None)), "record", h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), n, digest,
                             h.get("warc-refers-to", "").strip("<>") or None, block.doubt, payload)
                        )
                        held += len(payload or b"")
                        if len(rows) >= 2048 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    rows += [(archive, g.start, g.end, *(g.inner or (None, None)), "gap", None, None, None, None, None, None, g.reason, None) for g in salvage.gaps]
                    if rows:
                        yield batch_of(rows)

    return run


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """READ rows of the archives named in the first column: records and quarantined gaps.

    Defined results: an empty archive gives no rows; a wholly unreadable one a
    single gap from end to end; no byte is in no record and no gap, and none in
    both: ``offset`` and ``end`` are the bytes of a member or plain record, and
    ``inner_offset`` and ``inner_end`` the place in the member's decoded bytes; a
    record out of a member whose gzip data fail or break off has that as its
    reason.  Every archive is a task of its own (archives are written in pieces of
    ``max_bytes``), so reading spreads however small their list is.  Records may have any size; a payload beyond what a value of Spark holds (2 GiB) is null
    in ``payload``, its length and digest stand.
    """
    named = archives.select(F.col(archives.columns[0]).alias("archive"))
    count = named.count()
    spread = named.repartitionByRange(min(count, MAX_TASKS), "archive") if count > 1 else named
    return spread.mapInArrow(tidy(read_batches(payloads)), READ)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written as archives and read back.

    Null html is an empty payload, a null page_id comes back null, repeated rows
    keep a record each; an empty table gives no rows; other columns are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, **options)
    got = read_archives(manifest.select("archive")).where("kind = 'record'")
    number = lambda c: F.expr(f"try_cast(substring({c}, 12) as bigint)")  # noqa: E731  after urn:x-page:
    return got.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
