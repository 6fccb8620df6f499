"""WARC archives that survive damage: writing, and a salvage reader.

A record is accepted only if its checks hold: the version line and header
parse, the block has the stated length and end and, where a digest is stated,
that digest; a record without a digest in a gzip member needs the member's
checksum too. After a failed check the reader searches for the next place that
holds a valid record (a gzip member, or a version line of a plain record; in
the inflated bytes of a member, the next version line), goes on from there,
and logs the bytes it passed over as a quarantined gap. Of a member that is
torn, or damaged with several records in it, the records whose digests hold
are kept and carry the member's fault as their reason, as digests don't cover
headers.

Archives are read by position, a piece at a time, and members are inflated a
piece at a time, so memory is bounded by the longest record (and the records
of one member that lack digests), not by files, members or gaps. A stated
length is believed only if the record's end stands where it says. Files are
read in parallel; one file is one task, so writers should cut them
(``FILE_BYTES``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.scratch import fresh_path

#: Bytes of a file after which the writer begins the next; of one read; of the longest header.
FILE_BYTES, READ, LONGEST_HEADER = 32 << 20, 1 << 20, 16 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
ENTRIES = "kind string, file string, at bigint, size bigint, inner_at bigint, inner_size bigint, reason string, warc_type string, record_id string, url string, block binary, body_at int"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_FIELD = re.compile(rb"([^\x00-\x20:][^\x00-\x1f:]*):[^\r\n]*(?:\r?\n[ \t][^\r\n]*)*\r?\n")
_END = re.compile(rb"\r?\n\r?\n")


def record(kind: str, record_id: str, url: str, block: bytes) -> bytes:
    """One WARC/1.0 record, with a digest of its block."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if url:
        fields.insert(2, "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    return ("WARC/1.0\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A record as a gzip member of its own."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Wrong(Exception):
    """Why there is no valid record at a place."""


class More(Exception):
    """How many bytes from the record's start are needed to go on."""


def read_header(raw: bytes, whole: bool) -> tuple[dict[str, str], int]:
    """(fields by lowered name, length up to the block). Raises Wrong, or More unless ``whole``."""
    version = _VERSION_LINE.match(raw)
    if not version:
        if not whole and len(raw) < 12 and VERSION.startswith(raw[:7]):
            raise More(12)
        raise Wrong("no version line")
    at, fields = version.end(), {}
    while True:
        empty = re.compile(rb"\r?\n").match(raw, at)
        if empty and fields:
            break
        field = _FIELD.match(raw, at)
        # a line at the end may go on: it may be cut short, or be folded in what follows
        if (not field or field.end() >= len(raw) - 1) and not whole and len(raw) < LONGEST_HEADER and b"\x00" not in raw[at:]:
            if field or b"\n" not in raw[at:]:
                raise More(min(2 * len(raw) + 1024, LONGEST_HEADER))
        if not field:
            raise Wrong("broken header line" if b"\n" in raw[at:] else "no end of header")
        name, _, value = field[0].partition(b":")
        fields[name.strip().lower().decode("latin-1")] = re.sub(rb"\r?\n[ \t]+", b" ", value).strip().decode("utf-8", "replace")
        at = field.end()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise Wrong("missing fields")
    return fields, empty.end()


def digest_holds(fields: dict[str, str], block: bytes) -> bool | None:
    """Whether the stated digest (in base 32 or hexadecimal) is the block's; None if there is none that is known here."""
    algorithm, _, stated = fields.get("warc-block-digest", "").partition(":")
    if algorithm.lower() not in ("sha1", "sha256", "md5") or not stated:
        return None
    made = hashlib.new(algorithm.lower(), block).digest()
    return stated.strip().upper().rstrip("=") in (base64.b32encode(made).decode().rstrip("="), made.hex().upper())


def read_record(raw: bytes, whole: bool, believe: bool = True) -> tuple[dict[str, str], bytes, int, bool]:
    """(fields, block, length of the record, whether its digest was checked). Raises Wrong, or More unless ``whole``."""
    fields, at = read_header(raw, whole)
    size = int(fields["content-length"])
    if len(raw) < at + size + 4 and not whole:
        raise More(at + size + 4)
    if len(raw) < at + size:
        raise Wrong("short block")
    tail = _END.match(raw, at + size)
    if not tail:
        raise Wrong("no end of record")
    block = raw[at : at + size]
    held = digest_holds(fields, block)
    if held is False:
        raise Wrong("wrong digest")
    return fields, block, tail.end(), bool(held)


class Source:
    """A file by position; one piece of it is kept."""

    def __init__(self, f: BinaryIO) -> None:
        self.f, self.at, self.data = f, 0, b""
        self.seen: dict[bytes, int] = {}
        f.seek(0, 2)
        self.size = f.tell()

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; fewer only at the file's end."""
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.data):
            self.f.seek(at)
            self.data, self.at = self.f.read(max(n, READ)), at
            self.seen.clear()
        return self.data[at - self.at : at - self.at + n]

    def find(self, needle: bytes, at: int) -> int:
        """Where bytes begin in the piece that is kept, from ``at`` on; past its end if they don't."""
        if self.seen.get(needle, -1) < at:
            found = self.data.find(needle, at - self.at)
            self.seen[needle] = self.at + (found if found >= 0 else len(self.data) + 1)
        return self.seen[needle]


def plain_record(source: Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """The plain record at a place. Raises Wrong."""
    want = 4096
    while True:
        raw = source.get(at, want)
        try:
            fields, start = read_header(raw, len(raw) < want)
            break
        except More as more:
            want = more.args[0]
    size = int(fields["content-length"])
    if at + start + size > source.size:
        raise Wrong("short block")
    if not _END.match(source.get(at + start + size, 4)):  # looked up before the block is read: false lengths cost nothing
        raise Wrong("no end of record")
    fields, block, length, _ = read_record(source.get(at, start + size + 4), True)
    return fields, block, length


Row = tuple[str, int, int, "int | None", "int | None", str, dict[str, str], bytes]


def _gzip_header(raw: bytes) -> int:
    """The length of a gzip member's header, 0 if it is none."""
    if len(raw) < 10 or not raw.startswith(MAGIC) or raw[3] & 0xE0:
        return 0
    flags, at = raw[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(raw[at : at + 2], "little")
    for bit in (8, 16):  # name and comment
        if flags & bit:
            end = raw.find(b"\0", at)
            if end < 0:
                return 0
            at = end + 1
    at += 2 * bool(flags & 2)
    return at if at <= len(raw) else 0


def member_rows(source: Source, at: int) -> Iterator[Row]:
    """Rows of the gzip member at a place, with its bytes on the first; ends with the member's length, or None and the reason.

    Inside, whatever is no valid record is a gap up to the next version line
    that begins one. Of a broken member only records with good digests come,
    and its file bytes are left to the caller's gap.
    """
    z, pos, buffer, base, eof, failed = zlib.decompressobj(-15), at, bytearray(), 0, False, ""
    unsure: list[Row] = []  # records that wait for the member's checksum
    gap: int | None = None
    reason, want, crc, n = "", 12, 0, 0
    pos = at + (_gzip_header(source.get(at, 64)) or _gzip_header(source.get(at, 1 << 17)))
    if pos == at:
        yield ("failed", at, 0, None, None, "bad member: broken header", {}, b"")
        return
    pending, piece = b"", 4096

    def inflate() -> None:
        nonlocal pos, eof, failed, crc, n, pending, piece, z
        if not pending:
            pending = source.get(pos, piece)
            pos, piece = pos + len(pending), min(2 * piece, READ // 4 or 1)
        if not pending:
            eof, failed = True, "torn member"
            return
        before = z.copy()
        try:
            out = z.decompress(pending, 4 * READ)
            pending = z.unconsumed_tail
        except zlib.error as e:  # what came before the damage, in small steps
            out, z = b"", before
            try:
                for i in range(0, len(pending), 64):
                    out += z.decompress(pending[i : i + 64])
            except zlib.error:
                pass
            eof, failed = True, "bad member: " + re.sub(r"^Error -?\d+ while decompressing data: ", "", str(e))
        buffer.extend(out)
        crc, n = zlib.crc32(out, crc), n + len(out)
        if z.eof and not failed:
            eof, pos = True, pos - len(z.unused_data)
            trailer = source.get(pos, 8)
            pos += len(trailer)
            if len(trailer) < 8:
                failed = "torn member"
            elif trailer != crc.to_bytes(4, "little") + (n & 0xFFFFFFFF).to_bytes(4, "little"):
                failed = "bad member: wrong checksum"

    done = 0  # bytes of the buffer that are dealt with
    while True:
        while len(buffer) - done < want and not eof:
            inflate()
        if done > READ:
            del buffer[:done]
            base, done = base + done, 0
        if done == len(buffer) and eof:
            break
        try:
            fields, block, length, sure = read_record(bytes(buffer[done : done + want]) if want < len(buffer) - done else bytes(buffer[done:]), eof and want >= len(buffer) - done)
            row: Row = ("record", at, 0, base + done, length, "", fields, block)
        except More as more:
            want = max(want + 1, more.args[0])
            continue
        except Wrong as wrong:
            if gap is None:
                gap, reason = base + done, str(wrong)
            step = 1
            while True:
                found = buffer.find(VERSION, done + step)
                if found >= 0 or eof:
                    break
                step = max(1, len(buffer) - done - len(VERSION) + 1)
                inflate()
            done, want = found if found >= 0 else len(buffer), 12
            continue
        if gap is not None:
            yield ("gap", at, 0, gap, base + done - gap, reason, {}, b"")
            gap = None
        if sure:
            yield row
        else:
            unsure.append(row)
        done, want = done + length, 12
    if gap is not None:
        yield ("gap", at, 0, gap, base + len(buffer) - gap, reason, {}, b"")
    if failed:
        yield ("failed", at, 0, None, None, failed, {}, b"")
        return
    yield from unsure
    yield ("end", at, pos - at, None, None, "empty member" if not base + len(buffer) else "", {}, b"")


def _next_place(source: Source, at: int) -> int:
    """The next magic number or version line from ``at`` on; the end if there is none."""
    while at < source.size:
        source.get(at, len(VERSION))
        end = source.at + len(source.data)
        found = min(source.find(MAGIC, at), source.find(VERSION, at))
        if found < end:
            return found
        if end >= source.size:
            break
        at = max(at + 1, end - len(VERSION) + 1)
    return source.size


def salvage(f: BinaryIO) -> Iterator[Row]:
    """('record' | 'gap', offset, length, offset and length in the inflated member, reason, fields, block).

    Offsets and lengths of rows that are not inside a member cover every byte
    of the file once; of a member that several rows come from, the first has
    its length and the others 0, each with its place in the inflated bytes.
    """
    source, at = Source(f), 0
    start, reason = None, ""  # of the open gap
    while at < source.size:
        rows: list[Row] = []
        here = source.get(at, len(VERSION))
        length, why = 0, "no member or version line"
        if here.startswith(MAGIC):
            kept = []
            for row in member_rows(source, at):
                if row[0] == "failed":
                    why = row[5]
                elif row[0] == "end":
                    length, why = row[2], row[5]
                else:
                    kept.append(row)
            good = any(r[0] == "record" for r in kept)
            if length and not good and why != "empty member":
                why, length, kept = next((r[5] for r in kept), "no record"), 0, []
            if why == "empty member":
                length = 0
            if not length:
                kept = [r for r in kept if r[0] == "record"]
                # a digest vouches for a block only: damage in a lone record's member may be in its header
                kept = kept if why == "torn member" or len(kept) > 1 else []
                kept = [(*r[:5], why, *r[6:]) for r in kept]
            rows = kept
        elif here == VERSION:
            try:
                fields, block, length = plain_record(source, at)
                rows = [("record", at, length, None, None, "", fields, block)]
            except Wrong as wrong:
                why = str(wrong)
        if length:
            if start is not None:
                yield ("gap", start, at - start, None, None, reason, {}, b"")
                start = None
            for i, row in enumerate(rows):
                yield row if row[2] else (*row[:2], length if i == 0 else 0, *row[3:])
            at += length
            continue
        yield from rows  # saved from a member that is broken; its bytes are part of the gap
        if start is None:
            start, reason = at, why
        at = _next_place(source, at + 1)
    if start is not None:
        yield ("gap", start, source.size - start, None, None, reason, {}, b"")


def _body_at(block: bytes) -> int:
    """Where the body of an HTTP message begins; 0 for anything else."""
    if not block.startswith(b"HTTP/"):
        return 0
    end = _END.search(block)
    return end.end() if end else len(block)


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """Records and gaps of archives, one row each: kind, file, at, size, inner_at, inner_size, reason, warc_type, record_id, url, block, body_at.

    Gaps have a reason and null record columns, records that were saved from a
    broken member have its fault as reason; ``inner_at`` and
    ``inner_size`` are the place in a gzip member's inflated bytes, null
    elsewhere; ``body_at`` is where an HTTP message's body begins in the block.
    Blocks are bytes of any kind. An empty archive has no rows, nor has an
    empty list; a path that is listed twice is read twice. Every URI that
    Arrow's file systems can open will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                fs, where = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(where) as f:
                    for kind, at, size, inner_at, inner_size, reason, fields, block in salvage(f):
                        ok = kind == "record"
                        record = (fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), block if ok else None, _body_at(block) if ok else None)
                        rows.append((kind, path, at, size, inner_at, inner_size, reason or None, *record))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _entries(rows)
                            rows, held = [], 0
                yield _entries(rows)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files))).mapInArrow(run, ENTRIES)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    columns = [c.strip().split(" ") for c in ENTRIES.split(",")]
    cols = list(zip(*rows)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, columns)], names=[n for n, _ in columns])


def fault_of(record_id: str) -> str:
    """The fault that fault injection puts at a record: 'torn' copy in front, 'flip' within, 'noise' behind, or none."""
    return {0: "torn", 1: "flip", 2: "noise"}.get(zlib.crc32(record_id.encode()) % 100, "")


def page_record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def write_archives(pages: DataFrame, folder: str, faults: bool = False, file_bytes: int = FILE_BYTES) -> list[str]:
    """Write pages as gzipped WARC files to a shared folder; the files' URIs.

    Each page is a response record with its html as an HTTP body. A task
    writes under a name of its attempt and renames at the end, so retried and
    speculative tasks leave whole files with the same contents. Null urls are
    left out of the record, null html is an empty body. ``faults`` damages
    about three in a hundred records, chosen by their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        split, nth, size, out, draft = TaskContext.get().partitionId(), 0, 0, None, ""
        done = []

        def close() -> None:
            nonlocal out, nth, size
            out.close()
            name = f"part-{split:06d}-{nth:04d}.warc.gz"
            fs.move(draft, f"{root}/{name}")
            done.append(f"{folder}/{name}")
            out, nth, size = None, nth + 1, 0

        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None:
                    draft = f"{root}/.draft-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft, compression=None)
                body = (html or "").encode()
                name = page_record_id(page)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                data = member(record("response", name, url or "", block))
                fault = fault_of(name) if faults else ""
                if fault == "torn":
                    data = data[: len(data) // 2] + data
                elif fault == "flip":
                    half = len(data) // 2
                    data = data[:half] + bytes([data[half] ^ 0x55]) + data[half + 1 :]
                elif fault == "noise":
                    data += hashlib.sha256(name.encode()).digest()
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return sorted(r["file"] for r in rows.mapInArrow(run, "file string").collect())


def pages_from(entries: DataFrame) -> DataFrame:
    """(kind, file, at, size, reason, page_id, url, html, raw): the pages in the records; gaps have null pages.

    Bytes that are no UTF-8 become replacement characters in ``html``, and the
    body as it came is in ``raw`` then (null otherwise).
    """
    name = F.regexp_extract("record_id", "^<urn:page:([0-9-]+)>$", 1)
    rows = entries.withColumn("body", F.expr("substring(block, body_at + 1)"))
    text = F.col("body").cast("string")
    raw = F.when(~F.is_valid_utf8(text), F.col("body"))
    return rows.select("kind", "file", "at", "size", "reason", F.when(name != "", name.cast("bigint")).alias("page_id"), "url", F.make_valid_utf8(text).alias("html"), raw.alias("raw"))


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives with injected faults and read back: records and quarantined gaps."""
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"), faults=True)
    return pages_from(read_archives(spark, files))
