"""Benchmark decontamination by winnowing.

Texts become hashed words; every window of ``w`` consecutive k-grams keeps its
smallest k-gram hash (the rightmost of equals). Two texts that share a run of
at least ``k + w - 1`` words share a whole window and so a kept hash, whatever
surrounds the run. Matching fingerprints are extended word by word to the
maximal shared span, and spans of at least ``k + w - 1`` words are hits.

Every diagonal of a document and an item is walked once: seeds inside a span
that was found are dropped, and where a text repeats itself (a k-gram at equal
steps of at most k words) only the seeds at the edge of the repetition are
made, since the walk passes through the others.

The benchmark's fingerprints go to every task while they are small (their size
is checked); a larger benchmark is joined by shuffling the fingerprints of
both sides. Both ways give the same hits.

Limits: an item, or a shared passage, of fewer than ``k + w - 1`` words is no
hit. Scripts without spaces count a character as a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import filter_by_text, unused, with_row_ids
from loomgraph.llm.words import WordHasher, mix64, text_chunks

K, WINDOW = 6, 8
#: Text bytes of a benchmark up to which it is sent to every task.
BROADCAST_BYTES = 32 << 20
HIT = "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int"


def fingerprints(hashes: np.ndarray, first: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(word index, k-gram hash) of each kept k-gram; ``first``: rows' first words, then the end.

    A row of fewer than ``window`` k-grams is one window; one of fewer than
    ``k`` words has none.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = hashes[:n].copy()
        for j in range(1, k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    grams = mix64(grams)
    per_row = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate(([0], np.cumsum(per_row)))  # rows' first k-grams, when those across rows are gone
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], per_row)
    grams = grams[at]
    keep = np.zeros(len(grams), bool)
    m = len(grams) - window + 1
    if m > 0:
        best, where = grams[:m].copy(), np.zeros(m, np.int8)
        for j in range(1, window):
            less = grams[j : j + m] <= best
            np.copyto(best, grams[j : j + m], where=less)
            where[less] = j
        whole = np.repeat(begin[1:] - window, per_row)[:m] >= np.arange(m)  # windows that end in their row
        keep[(np.arange(m) + where)[whole]] = True
    short = np.flatnonzero((per_row > 0) & (per_row < window))
    if len(short):
        least = np.minimum.reduceat(grams, begin[short]) if len(short) == len(per_row) else None
        for r in short.tolist() if least is None else ():
            part = slice(begin[r], begin[r + 1])
            keep[begin[r] + per_row[r] - 1 - int(np.argmin(grams[part][::-1]))] = True
        if least is not None:
            for r, v in zip(short.tolist(), least):
                part = grams[begin[r] : begin[r + 1]]
                keep[begin[r] + int(np.flatnonzero(part == v)[-1])] = True
    kept = np.flatnonzero(keep)
    return at[kept], grams[kept]


def _runs(text: np.ndarray, grams: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry, entries, step) of runs of one k-gram of one text at equal steps of at most ``k`` words; sorted by (gram, text, at)."""
    n = len(at)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    step = np.diff(at)
    near = (text[1:] == text[:-1]) & (grams[1:] == grams[:-1]) & (step <= k)
    joins = near.copy()
    joins[1:] &= ~near[:-1] | (step[1:] == step[:-1])
    begin = np.flatnonzero(np.concatenate(([True], ~joins)))
    size = np.diff(np.concatenate((begin, [n])))
    return begin, size, np.where(size > 1, np.concatenate((step, [0]))[begin], 0)


class Items:
    """Words of all benchmark items and their fingerprints, as runs sorted by hash."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> None:
        self.ids, self.hashes, self.first = ids, hashes, first
        at, grams = fingerprints(hashes, first, k, window)
        item = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, item, grams))
        self.at = at[order]
        begin, self.size, self.step = _runs(item[order], grams[order], self.at, k)
        self.begin, self.grams, self.item = begin, grams[order][begin], item[order][begin]


def extend(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, item: np.ndarray, ilo: np.ndarray, ihi: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal equal runs round matching k-grams: (start in doc, start in item, words).

    ``p``, ``q``: word indices of the k-grams; lo/hi, ilo/ihi: the bounds of
    their texts. A pair of k-grams that differ in words (equal hashes by
    chance) has length 0.
    """
    same = np.ones(len(p), bool)
    for j in range(k):
        same &= doc[p + j] == item[q + j]
    left, right = np.zeros(len(p), np.int64), np.full(len(p), k, np.int64)
    live = np.flatnonzero(same)
    while len(live):
        a, b = p[live] - left[live] - 1, q[live] - left[live] - 1
        ok = (a >= lo[live]) & (b >= ilo[live])
        ok[ok] = doc[a[ok]] == item[b[ok]]
        live = live[ok]
        left[live] += 1
    live = np.flatnonzero(same)
    while len(live):
        a, b = p[live] + right[live], q[live] + right[live]
        ok = (a < hi[live]) & (b < ihi[live])
        ok[ok] = doc[a[ok]] == item[b[ok]]
        live = live[ok]
        right[live] += 1
    return p - left, q - left, np.where(same, left + right, 0)


def spans(doc: np.ndarray, first: np.ndarray, row: np.ndarray, p: np.ndarray, items: Items, item: np.ndarray, q: np.ndarray, k: int, least: int) -> np.ndarray:
    """Rows (row, item index, doc word, item word, words) of the maximal spans through seeds; each diagonal's spans once."""
    order = np.lexsort((p, p - q, item, row))
    row, p, item, q = row[order], p[order], item[order], q[order]
    found = [np.zeros((0, 5), np.int64)]
    while len(p):
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1])))
        head, of = np.flatnonzero(new), np.cumsum(new) - 1
        lo, ilo = first[row[head]], items.first[item[head]]
        a, c, n = extend(doc, lo, first[row[head] + 1], p[head], items.hashes, ilo, items.first[item[head] + 1], q[head], k)
        found.append(np.stack([row[head], item[head], a - lo, c - ilo, n], 1)[n >= least])
        left = ~new & (p + k > (a + n)[of])  # seeds within a span that was found lead to it again
        row, p, item, q = row[left], p[left], item[left], q[left]
    return np.unique(np.concatenate(found), axis=0)


def find_hits(hashes: np.ndarray, first: np.ndarray, items: Items, k: int, window: int) -> np.ndarray:
    """Rows (row, item index, doc word, item word, words) of all maximal spans, in order."""
    at, grams = fingerprints(hashes, first, k, window)
    left = np.searchsorted(items.grams, grams, "left")
    hit = left < len(items.grams)
    hit[hit] = items.grams[left[hit]] == grams[hit]
    at, grams = at[hit], grams[hit]
    if not len(at):
        return np.zeros((0, 5), np.int64)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((at, row, grams))
    at, grams, row = at[order], grams[order], row[order]
    begin, size, step = _runs(row, grams, at, k)
    left, right = np.searchsorted(items.grams, grams[begin], "left"), np.searchsorted(items.grams, grams[begin], "right")
    d = np.repeat(np.arange(len(begin)), right - left)  # runs of documents that meet runs of items
    e = np.repeat(left - np.concatenate(([0], np.cumsum(right - left)[:-1])), right - left) + np.arange(len(d))
    edge = (size[d] == 1) | (items.size[e] == 1) | (step[d] == items.step[e])
    # along equal steps the seeds at the edges reach all others; else every entry meets every entry
    n, m = size[d], items.size[e]
    count = np.where(edge, n + m - 1, n * m)
    pair = np.repeat(np.arange(len(d)), count)
    i = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    n, m = n[pair], m[pair]
    x = np.where(edge[pair], np.minimum(i, n - 1), i // m)
    y = np.where(edge[pair], np.maximum(i - n + 1, 0), i % m)
    x = np.where(edge[pair] & (i >= n), 0, x)
    p, q = at[begin[d][pair] + x], items.at[items.begin[e][pair] + y]
    return spans(hashes, first, row[begin[d]][pair], p, items, items.item[e][pair], q, k, k + window - 1)


def _load_items(benchmark: DataFrame, k: int, window: int) -> Items:
    table = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL").distinct().orderBy("item_id", "text").toArrow()
    hasher, hashes, firsts, n = WordHasher(), [], [], 0
    text = pa.concat_arrays(table["text"].chunks) if table.num_rows else pa.array([], pa.string())
    for _, _, data, offsets in text_chunks(text, lower=True):
        h, _, _, first = hasher.words(data, offsets)
        hashes.append(h)
        firsts.append(first[:-1] + n)
        n += len(h)
    empty = np.zeros(0, np.int64)
    return Items(table["item_id"].to_numpy(), np.concatenate(hashes or [empty.astype(np.uint64)]), np.concatenate([*firsts, [n]]).astype(np.int64), k, window)


def is_small(benchmark: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the benchmark's texts may go to every task."""
    return (benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) <= most


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per maximal span of at least ``k + window - 1`` words shared by a document and an item.

    Columns: doc_id, item_id, doc_word and item_word (the span's first words,
    from 0), n_words. Rows are distinct: a repeated document or item adds
    none. Null or empty texts share nothing; rows without an id are not
    reported, as they could not be named. Empty tables give no rows. Other
    columns of either table are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    if not is_small(benchmark, broadcast_bytes):
        return _leaks_by_join(docs, benchmark, k, window)
    items = _load_items(benchmark, k, window)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, _, data, offsets in text_chunks(batch.column("text"), lower=True):
                hashes, _, _, first = hasher.words(data, offsets)
                found = find_hits(hashes, first, items, k, window)
                if len(found):
                    row, item, a, c, n = found.T
                    arrays = [ids[row + begin], items.ids[item], a.astype(np.int32), c.astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return docs.mapInArrow(search, HIT).distinct()


def _postings(texts: DataFrame, id_name: str, k: int, window: int) -> DataFrame:
    """(id, word, gram) of every kept k-gram."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0)
            for begin, _, data, offsets in text_chunks(batch.column("text"), lower=True):
                hashes, _, _, first = hasher.words(data, offsets)
                at, grams = fingerprints(hashes, first, k, window)
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + begin)), pa.array((at - first[row]).astype(np.int32)), pa.array(grams.view(np.int64))], names=[id_name, "word", "gram"])

    kind = texts.schema[id_name].dataType.simpleString()
    return texts.select(id_name, "text").mapInArrow(emit, f"{id_name} {kind}, word int, gram bigint")


def _leaks_by_join(docs: DataFrame, benchmark: DataFrame, k: int, window: int) -> DataFrame:
    """The hits for a benchmark that is too large to send.

    Distinct fingerprints of both sides meet in a shuffle join, which names
    the pairs of texts; those are then searched as by the other way, one item
    against the documents that met it in a batch.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL").distinct()
    d, b = (_postings(t, c, k, window).select(c, "gram").distinct() for t, c in ((docs, "doc_id"), (items, "item_id")))
    met = d.join(b, "gram").select("doc_id", "item_id").distinct()
    # a repeated id may have another text: what does not match there gives no span
    pairs = met.join(docs.distinct(), "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(), {}

        def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            parts, firsts, n = [np.zeros(0, np.uint64)], [], 0
            for _, _, data, offsets in text_chunks(text, lower=True):
                h, _, _, first = hasher.words(data, offsets)
                parts.append(h)
                firsts.append(first[:-1] + n)
                n += len(h)
            return np.concatenate(parts), np.concatenate([*firsts, [n]]).astype(np.int64)

        for batch in batches:
            ids, texts = np.array(batch.column("item_id").to_pylist()), batch.column("item_text")
            keys = np.array([hash((i, t)) for i, t in zip(ids.tolist(), texts.to_pylist())], np.int64)
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                one = held.get(key)
                if one is None:
                    h, first = words(texts.slice(int(at[0]), 1))
                    held.clear()  # pairs of an item tend to come together
                    one = held[key] = Items(ids[at[:1]], h, first, k, window)
                part = batch.take(pa.array(at))
                h, first = words(part.column("text"))
                row, _, a, c, n = find_hits(h, first, one, k, window).T
                names = part.column("doc_id").take(pa.array(row)), pa.array(np.full(len(row), ids[at[0]], np.int64))
                yield pa.RecordBatch.from_arrays([*names, *(pa.array(x.astype(np.int32)) for x in (a, c, n))], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return pairs.select("doc_id", "item_id", "text", "item_text").repartition("item_id", F.expr("pmod(xxhash64(doc_id), 64)")).sortWithinPartitions("item_id").mapInArrow(verify, HIT).distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that share a span with an item; all columns as they are, whatever their names.

    Rows are judged by their own text, so those without an id are too, and
    clean rows stay as often as they were; null and empty texts are clean.
    With a small benchmark nothing is shuffled; with a large one rows are
    numbered and found ones leave by number.
    """
    if not is_small(benchmark, broadcast_bytes):
        (row,) = unused(docs.columns, "row_number")
        numbered = with_row_ids(docs, row, "numbered")
        texts = numbered.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))
        bad = _leaks_by_join(texts, benchmark, k, window).select(F.col("doc_id").alias(row)).distinct()
        return numbered.join(bad, row, "left_anti").drop(row)
    items = _load_items(benchmark, k, window)

    def judge():
        hasher = WordHasher()

        def kept(texts: pa.Array) -> pa.Array:
            keep = np.ones(len(texts), bool)
            for begin, _, data, offsets in text_chunks(texts, lower=True):
                hashes, _, _, first = hasher.words(data, offsets)
                keep[find_hits(hashes, first, items, k, window)[:, 0] + begin] = False
            return pa.array(keep)

        return kept

    return filter_by_text(docs, judge)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
