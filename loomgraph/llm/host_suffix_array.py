"""Text of web pages without what a host repeats.

Pages are parsed once, into lots of a bounded size that are written to the
shared folder. The token streams of a lot's pages are concatenated, host by
host, and their suffixes sorted by their first ``MIN_TOKENS`` tokens (a suffix
array to that depth, by prefix doubling). Neighbours that agree so far and lie
on distinct pages are repeats; every token that a repeat covers is removed,
and what is left are the page's unique runs. A longer repeat is the union of
its windows of ``MIN_TOKENS`` tokens, so that depth finds all: the result is
that of all maximal common substrings (LCP) of at least so many tokens.

A host lies in many lots, whose suffix arrays meet in two steps. Equal windows
have equal minimizers (the least hash of their runs of ``MINI`` tokens), of
which a text has few: each lot sends its distinct ones, and learns which of
them other lots have too. Then it sends the windows of those, each distinct
one once, as a 64-bit hash with the number of pages it occurs on there; the
counts of all lots are added, and the lot learns which windows reach the
bound. Hashes deal both to parts of even size, and answers are bits, stored
where the tasks that hold the lots read them, so texts are never shuffled. No
host is treated apart: a window that every page of a hot host carries is one
entry a lot.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.words import WordHasher, mix64, text_chunks
from loomgraph.scratch import fresh_path, materialize

MIN_TOKENS, MIN_PAGES, MINI = 8, 2, 4
#: Tasks whose lots' answers are stored together.
GROUP = 8
#: Bytes of html in a lot (or one longer page); bytes of html for each part of the windows.
LOT_BYTES, PART_BYTES = 8 << 20, 64 << 20
RESULT = "page_id bigint, url string, text string, n_tokens int, n_removed int"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|nav|footer|header|article|section|aside|main|pre|blockquote|form|body|html|title|dl|dt|dd|hr)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z!?][^<>]*(?:>|\Z)")


def visible_text(source: str) -> str:
    """The text of a page: blocks on lines of their own, no scripts, styles, head or comments."""
    text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", source)))
    return html_lib.unescape(text) if "&" in text else text


def host_of(url: str = "url") -> Column:
    """Column: the lowered host of a URL; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _tokens(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start and end byte within its page, each page's first token and the end) of pages' tokens."""
    parts, firsts, n = [], [], 0
    for _, _, data, offsets in text_chunks(texts):
        h, s, e, first = hasher.words(data, offsets)
        base = np.repeat(offsets[:-1], np.diff(first))
        parts.append((h, s - base, e - base))
        firsts.append(first[:-1] + n)
        n += len(h)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return *(np.concatenate([p[i] for p in parts]) for i in range(3)), np.concatenate([*firsts, [n]])


def window_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` tokens, by prefix doubling; equal ranks agree so far.

    Only suffixes of at least ``depth`` tokens have one.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.uint64)
    done = 1
    while done < depth:
        step = min(done, depth - done)  # the last step overlaps, if depth is no power of two
        n = len(tokens) - done - step + 1
        rank = np.unique((rank[:n] << np.uint64(32)) | rank[step if step < done else done :][:n], return_inverse=True)[1].astype(np.uint64)
        done += step
    return rank


def _starts(first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(token index, page) of each window of ``depth`` tokens that lies on one page."""
    count = np.maximum(np.diff(first) - depth + 1, 0)
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    page = np.repeat(np.arange(len(count)), count)
    return np.arange(int(count.sum())) - before[page] + first[page], page


def covered(first: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Which tokens lie in one of the windows that start ``at`` the given tokens."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + depth, -1)
    return np.cumsum(edge[:-1]) > 0


def _unique_runs(texts: list[str], starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> tuple[list[str], list[int], list[int]]:
    """Each page's text between removed tokens, runs on lines of their own, and its tokens kept and removed."""
    out, kept, removed = [], [], []
    for i, text in enumerate(texts):
        lo, hi = first[i], first[i + 1]
        off = gone[lo:hi]
        n = int(off.sum())
        kept.append(int(hi - lo) - n)
        removed.append(n)
        raw = text.encode()
        edge = np.flatnonzero(np.diff(np.concatenate(([True], off, [True])).astype(np.int8)))
        runs = [raw[starts[lo + a] : ends[lo + b - 1]].decode() for a, b in zip(edge[::2], edge[1::2])]
        out.append("\n".join(re.sub(r"[ \t\r\f\v]*\n\s*", "\n", r) for r in runs))
    return out, kept, removed


def _result(ids: list, urls: list, texts: list, kept: list, removed: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, urls, texts, kept, removed), kinds)], names=["page_id", "url", "text", "n_tokens", "n_removed"])


def _blob(texts: list[str]) -> bytes:
    """Texts as one compressed run, its length in front; shared wording of a host's pages packs well."""
    raw = "\0".join(texts).encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def _unblob(blob: bytes) -> list[str]:
    size = int.from_bytes(blob[:8], "little")
    return (pa.Codec("zstd").decompress(blob[8:], size, asbytes=True).decode() if size else "").split("\0")


class Lot:
    """The token streams of a lot's pages; windows are equal if their tokens and hosts are."""

    def __init__(self, hosts: list[str], texts: list[str], depth: int) -> None:
        self.depth = depth
        self.tokens, self.starts, self.ends, self.first = _tokens(pa.array(texts, pa.string()), WordHasher(by_space=True))
        self.at, self.page = _starts(self.first, depth)
        self.seeds = np.array([xxhash.xxh3_64_intdigest(h.encode()) for h in hosts], np.uint64)

    def _hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        hashes = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + self.tokens[at + j]
        return mix64(hashes)

    def minimizers(self) -> np.ndarray:
        """The minimizer of each window."""
        n = min(MINI, self.depth)
        if not len(self.at):
            return np.zeros(0, np.uint64)
        each = self._hashes(np.arange(len(self.tokens) - n + 1), n)
        least = each[self.at].copy()
        for j in range(1, self.depth - n + 1):
            np.minimum(least, each[self.at + j], out=least)
        return mix64(least ^ self.seeds[self.page])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows' hashes, the number of each window among them, and the pages each occurs on."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = window_ranks(self.tokens, self.depth)[self.at]
        host = np.unique(self.seeds, return_inverse=True)[1].astype(np.uint64)[self.page]
        if len(np.unique(self.seeds)) > 1:
            rank = np.unique(rank.astype(np.uint64) << np.uint64(24) | host, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")  # the suffix array: pages of a window follow each other
        r, p = rank[order], self.page[order]
        new = np.concatenate(([True], r[1:] != r[:-1]))
        fresh = new | np.concatenate(([True], p[1:] != p[:-1]))
        group = np.cumsum(new) - 1
        number = np.empty(len(r), np.int64)
        number[order] = group
        some = order[new]
        with np.errstate(over="ignore"):
            grams = mix64(self._hashes(self.at[some], self.depth) + self.seeds[self.page[some]])
        return grams, number, np.bincount(group, weights=fresh).astype(np.int64)


def _dealt(values: np.ndarray, parts: int) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """(order of distinct values by part, the parts, and each one's begin and end in that order)."""
    part = (values % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((values, part))
    which, begin = np.unique(part[order], return_index=True)
    return order, which.tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)]


def _answers(values: np.ndarray, parts: int, bits: dict[int, bytes]) -> np.ndarray:
    """The flags that came back for distinct values."""
    order, which, begin, end = _dealt(values, parts)
    flags = np.zeros(len(values), bool)
    for k, a, b in zip(which, begin, end):
        if k in bits:
            flags[order[a:b]] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a).astype(bool)
    return flags


def _count(table: pa.Table, least: int) -> pa.Table:
    """Of one part: which values of each lot reach a count in all lots together."""
    raw, width = table["entries"].to_pylist(), int(table["width"][0].as_py())
    wide = np.zeros((sum(len(r) for r in raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8) if table["counts"].null_count == 0 else None
    number = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True)[1]
    flags = (np.bincount(number, weights=counts) >= least)[number] if len(number) else np.zeros(0, bool)
    ends = np.cumsum([len(r) // width for r in raw]).tolist()
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
    return pa.table({"lot": table["lot"], "part": table["part"], "bits": pa.array(bits, pa.binary())})


ENTRY = "lot bigint, part bigint, width int, entries binary, counts binary"


def _entries(lot: int, values: np.ndarray, parts: int, width: int, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """A lot's distinct values, ``width`` bytes of each besides the part, and counts up to 255."""
    order, which, begin, end = _dealt(values, parts)
    kept = np.ascontiguousarray((values if width == 8 else values // np.uint64(parts))[order]).view(np.uint8).reshape(-1, 8)[:, :width]
    some = None if counts is None else np.minimum(counts, 255).astype(np.uint8)[order]
    cols = ([lot] * len(which), pa.int64()), (which, pa.int64()), ([width] * len(which), pa.int32()), ([kept[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()), ([None if some is None else some[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], names=["lot", "part", "width", "entries", "counts"])


def _meet(entries: DataFrame, parts: int, least: int, tag: str) -> str:
    """Count the entries of all lots, and store the answers, by the tasks that hold the lots; the folder."""

    def count(table: pa.Table) -> pa.Table:
        return _count(table, least)

    found = entries.repartition(parts, "part").groupBy("part").applyInArrow(count, "lot bigint, part bigint, bits binary")
    path = fresh_path(entries.sparkSession, tag)
    grouped = found.withColumn("grp", F.expr(f"shiftright(lot, 32) div {GROUP}"))
    grouped.repartition(max(1, -(-parts // 4)), "grp").sortWithinPartitions("grp", "lot").write.partitionBy("grp").parquet(path)
    return path


class Answers:
    """The stored answers, lot by lot; those of one group of tasks are kept."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path)
        self.group, self.table = -1, None

    def of(self, lot: int) -> dict[int, bytes]:
        group = (lot >> 32) // GROUP
        if group != self.group:
            where = f"{self.root}/grp={group}"
            there = self.fs.get_file_info(where).type == pafs.FileType.Directory
            self.group, self.table = group, pads.dataset(where, format="parquet", filesystem=self.fs).to_table(["lot", "part", "bits"]) if there else None
        if self.table is None:
            return {}
        lots = self.table["lot"].to_numpy()
        mine = self.table.take(pa.array(np.flatnonzero(lots == lot)))
        return dict(zip(mine["part"].to_pylist(), mine["bits"].to_pylist()))


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, lot_bytes: int = LOT_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(page_id, url, text, n_tokens kept, n_removed), one row per row of ``pages``.

    Rows count as pages of their own, so a page that is repeated, with its id
    or under another, is all repeat and left empty. A null url has the host
    ''; null or empty html gives an empty text; a page of any length is one
    text. Ids may be null. Tokens are runs between white space, compared as
    written. Empty tables give none; other columns are not read.
    """
    if not 1 <= min_pages <= 255:
        raise ValueError("min_pages must be from 1 to 255")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.array([len(h) if h else 0 for h in batch.column("html").to_pylist()], np.int64)
            lot = np.cumsum(size) // lot_bytes
            for i in np.unique(lot).tolist():
                part = batch.filter(pa.array(lot == i))
                texts = [visible_text(h).replace("\0", " ") if h else "" for h in part.column("html").to_pylist()]
                cols = ([number], pa.int64()), ([part.column("host").to_pylist()], pa.list_(pa.string())), ([part.column("page_id").to_pylist()], pa.list_(pa.int64())), ([part.column("url").to_pylist()], pa.list_(pa.string())), ([_blob(texts)], pa.binary()), ([int(size[lot == i].sum())], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], names=["lot", "hosts", "ids", "urls", "blob", "size"])
                number += 1

    lots = materialize(rows.mapInArrow(parse, "lot bigint, hosts array<string>, ids array<bigint>, urls array<string>, blob binary, size bigint"), "lots")
    total = lots.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(-(-total // part_bytes), pages.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, Lot, list[str]]]:
        for batch in batches:
            for lot, hosts, ids, urls, blob in zip(*(batch.column(c).to_pylist() for c in ("lot", "hosts", "ids", "urls", "blob"))):
                texts = _unblob(blob)
                yield lot, ids, urls, Lot(hosts, texts, min_tokens), texts

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, lot, _ in read(batches):
            yield _entries(number, np.unique(lot.minimizers()), parts, 5)  # an accidental match costs a window, no more

    def shared_windows(lot: Lot, answers: Answers, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lot's windows, and which distinct ones have a minimizer that other lots have too."""
        grams, of, pages = lot.windows()
        minis, mini_of = np.unique(lot.minimizers(), return_inverse=True)
        shared = np.zeros(len(grams), bool)
        shared[of] = _answers(minis, parts, answers.of(number))[mini_of]
        return grams, of, pages, shared

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(met)
        for number, _, _, lot, _ in read(batches):
            grams, _, pages, shared = shared_windows(lot, answers, number)
            yield _entries(number, grams[shared], parts, 8, pages[shared])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Answers(met), Answers(counted)
        for number, ids, urls, lot, texts in read(batches):
            grams, of, pages, shared = shared_windows(lot, first, number)
            many = pages >= min_pages
            many[shared] = _answers(grams[shared], parts, second.of(number))
            gone = covered(lot.first, lot.at[many[of]], min_tokens)
            yield _result(ids, urls, *_unique_runs(texts, lot.starts, lot.ends, lot.first, gone))

    rows = lots.drop("size")
    met = _meet(rows.mapInArrow(minimizers, ENTRY), parts, 2, "minimizers")
    counted = _meet(rows.mapInArrow(windows, ENTRY), parts, min_pages, "windows")
    return rows.mapInArrow(clean, RESULT)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
