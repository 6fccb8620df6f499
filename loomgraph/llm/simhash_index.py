"""Near-duplicate groups by SimHash, over an inverted index of positional bytes.

Each text has a 256-bit SimHash of its set of words: 32 positional bytes. Two
texts whose fingerprints differ in few bits agree in many bytes at the same
positions, and agreement in bytes is what the index finds.

Shared bytes are tallied over all 32 positions: a pair is a candidate exactly
if it agrees at ``TALLY`` (three) positions or more. Tallying posting lists of
single bytes pair by pair is quadratic, since each holds 1/256 of the corpus,
so a list is searched by two more bytes: entries travel once to each list of
(position, byte), and there those that also agree at two later positions are
brought together by sorting, for every two such positions. That visits every
triple of positions, hence every pair with a tally of three: each pair within
29 bits, and of pairs that differ in 46 random bits 99 % (simulated).
Candidates are verified by Hamming distance, at most ``MAX_BITS``, and groups
are the connected components of verified pairs.

Equal fingerprints are one entry of the index, so thousands of exact copies
cost no pairs. Where more than 24 entries meet only the edges of a spanning forest are
kept, found by breadth-first search over what is still unreached.

What is reported: each document's class, and how many different texts are
within the bound of its own. Those are counted inside the classes, in blocks
of entries, so no pair is written, and links that the index did not need to
connect a class count too. Decisions are made over fingerprints and row
numbers; a text is never judged by its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.llm.columns import unused, with_row_ids
from loomgraph.llm.words import WordHasher, mix64, text_chunks
from loomgraph.scratch import drop_table, materialize

N_BYTES, TALLY, MAX_BITS = 32, 3, 46
#: Entries that a task sorts at once; a posting list that is longer is one such lot.
LOT = 1 << 16
#: Entries of a class that are compared with each other, or with as many others, at once.
BLOCK = 1 << 11
#: Fingerprints of more than this share of the rows meet their rows by broadcast: there are no more of them than its inverse.
HOT = 4096
BITS = ["f0", "f1", "f2", "f3"]
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def simhash(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their fingerprints as rows of four uint64); ``first``: rows' first words, then the end."""
    counts = np.diff(first)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return rows, np.zeros((0, 4), np.uint64)
    # one sort finds each row's distinct words: 20 bits of row, 44 of hash
    tagged = np.sort((np.repeat(np.arange(len(counts)), counts).astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    tagged = tagged[np.concatenate(([True], tagged[1:] != tagged[:-1]))]
    of = (tagged >> np.uint64(44)).astype(np.int64)
    word = tagged & np.uint64((1 << 44) - 1)
    begin = np.searchsorted(of, rows)
    size = np.diff(np.concatenate((begin, [len(of)])))
    ones = np.empty((len(rows), 256), np.int32)
    step = 1 << 14  # words at a time, in whole rows where they fit
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + step, "right")) - 1) if begin[-1] > begin[i] + step else len(rows)
        lo, hi = begin[i], begin[j] if j < len(rows) else len(of)
        if hi - lo <= 4 * step:
            ones[i:j] = np.add.reduceat(_bits(word[lo:hi]), begin[i:j] - lo, axis=0, dtype=np.int32)
        else:
            ones[i:j] = 0
            for s in range(lo, hi, step):
                ones[i] += _bits(word[s : min(s + step, hi)]).sum(0, dtype=np.int32)
        i = j
    return rows, np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64)


def _bits(word: np.ndarray) -> np.ndarray:
    mixed = np.stack([mix64(word ^ np.uint64(s)) for s in _SALTS], 1)
    return np.unpackbits(mixed.view(np.uint8), axis=1)


def fingerprint(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with f0..f3 in place of ``text``; those without a word are left out."""
    kept = [c for c in rows.columns if c != text]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for begin, _, data, offsets in text_chunks(batch.column(text), lower=True):
                hashes, _, _, first = hasher.words(data, offsets)
                at, prints = simhash(hashes, first)
                parts, where = prints.view(np.int64), pa.array(at + begin)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in kept), *(pa.array(np.ascontiguousarray(parts[:, i])) for i in range(4))], names=[*kept, *BITS])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} bigint" for c in BITS]
    return rows.mapInArrow(emit, ", ".join(kinds))


def postings(prints: DataFrame) -> DataFrame:
    """(key, rep, f0..f3): a row per fingerprint and position that TALLY - 1 others follow; the key is position and byte. Made in the JVM."""

    def key(p: int) -> str:
        return f"CAST({p << 8}L | (shiftrightunsigned(f{p // 8}, {8 * (p % 8)}) & 255L) AS INT)"

    keys = [key(p) for p in range(N_BYTES - TALLY + 1)]
    return prints.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), "rep", *BITS)


def near_edges(prints: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the graph of entries within ``most`` bits."""
    edges, rest = [], np.arange(len(prints))
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            u = reached.pop()
            near = np.bitwise_count(prints[rest] ^ prints[u]).sum(1) <= most
            new = rest[near].tolist()
            edges += [(u, v) for v in new]
            reached += new
            rest = rest[~near]
    return edges


def _verified(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """Distinct edges (smaller id, larger id) from sorted, whole posting lists."""
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((begin, [len(keys)])))
    found = []
    few = (size > 1) & (size <= 24)
    for n in np.unique(size[few]).tolist():  # all pairs at once, list size by list size
        at = begin[size == n]
        a, b = np.triu_indices(n, 1)
        left, right = (at[:, None] + a).ravel(), (at[:, None] + b).ravel()
        near = np.bitwise_count(prints[left] ^ prints[right]).sum(1) <= most
        found.append(np.stack([ids[left[near]], ids[right[near]]], 1))
    for at, n in zip(begin[size > 24].tolist(), size[size > 24].tolist()):
        edges = np.array(near_edges(prints[at : at + n], most), np.int64).reshape(-1, 2) + at
        found.append(ids[edges])
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate(found)
    pairs = np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _met(tagged: np.ndarray) -> np.ndarray:
    """Of (key << 32 | row) those whose key is not alone, sorted."""
    tagged = np.sort(tagged)
    key = tagged >> np.uint64(32)
    same = key[1:] == key[:-1]
    return tagged[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(tagged) else tagged


def _tallied(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, most: int) -> np.ndarray:
    """Distinct edges among whole posting lists of one position, of pairs that agree at two later positions as well."""
    found, low, row = [np.zeros((0, 2), np.int64)], np.uint64(0xFFFFFFFF), np.arange(len(ids), dtype=np.uint64)
    at = [np.ascontiguousarray(c).astype(np.uint64) for c in prints.view(np.uint8).reshape(-1, N_BYTES).T]
    lists = (keys & 255).astype(np.uint64) << np.uint64(48) | row
    for q in range(int(keys[0]) // 256 + 1, N_BYTES - 1):
        two = _met(lists | at[q] << np.uint64(40))
        if not len(two):
            continue
        of, here = (two & low).astype(np.int64), []
        for r in range(q + 1, N_BYTES):
            three = _met(two | at[r][of] << np.uint64(32))
            if len(three):
                i = (three & low).astype(np.int64)
                here.append(_verified(three >> np.uint64(32), ids[i], prints[i], most))
        found.append(np.unique(np.concatenate(here), axis=0) if here else found[0])
    return np.unique(np.concatenate(found), axis=0)


def candidate_edges(prints: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Distinct verified edges (a, b), a < b, over entries (rep, f0..f3)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(lots: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            keys, ids, fps = (np.concatenate([h[i] for h in lots]) for i in range(3))
            ends = np.flatnonzero(np.diff(keys >> 8)) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(keys)]):
                edges = _tallied(keys[lo:hi], ids[lo:hi], fps[lo:hi], most)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = np.stack([batch.column(i).to_numpy() for i in range(2, 6)], 1).view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if sum(len(h[0]) for h in held) + cut >= LOT and (cut or held[-1][0][-1] != keys[0]):
                yield from out([*held, (keys[:cut], ids[:cut], fps[:cut])])
                held, keys, ids, fps = [], keys[cut:], ids[cut:], fps[cut:]
            held.append((keys, ids, fps))
        if held:
            yield from out(held)

    prints = prints.select("rep", *BITS)
    # lists of a position go together, as many as make a lot: sorting many small lists at once costs what one does
    parts = max(1, min(256, round(prints.count() / LOT)))
    by_key = postings(prints).repartition(F.expr("key DIV 256"), F.expr(f"key % {parts}")).sortWithinPartitions("key")
    return by_key.mapInArrow(search, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least id of its component.

    Alternates large-star and small-star steps until no edge changes; each
    round is written to the shared folder, and the one before is deleted.
    """
    edges = materialize(edges, "edges")
    mark = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(W.partitionBy("a")))
        big = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = big.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        tagged = low.withColumn("m", F.min("b").over(W.partitionBy("a")))
        small = tagged.select(F.col("b").alias("a"), F.col("m").alias("b")).union(tagged.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, materialize(small, "edges")
        drop_table(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def classes(entries: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``entries`` (rep, f0..f3, ...) with ``root``, the least rep of the class."""
    roots = components(candidate_edges(entries.select("rep", *BITS), most))
    return entries.join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")


def links(entries: DataFrame, most: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(rep, n): of each entry (rep, root, f0..f3, weight) the weights of the other entries of its class within ``most`` bits.

    A class is dealt to blocks by a hash; each two blocks of a class (and each
    with itself) meet in one lot, whatever the size of the class, and a lot
    sends one partial sum an entry.
    """
    size = entries.groupBy("root").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("root").alias("__root"), F.ceil(F.col("__n") / block).cast("int").alias("blocks"))
    rows = entries.join(size, F.col("root") == F.col("__root")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.select("rep", "root", *BITS, F.col("weight").cast("bigint").alias("weight"), "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.col("mine").cast("bigint").alias("mine"), "rep", "weight", *BITS)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(t: np.ndarray) -> pa.RecordBatch:
            key = t[:, :3]
            begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
            size, sums = np.diff(np.concatenate((begin, [len(t)]))), np.zeros(len(t), np.int64)
            prints, weight, mine = np.ascontiguousarray(t[:, 6:]).view(np.uint64), t[:, 5], t[:, 3]
            for n in np.unique(size[size <= 24]).tolist():
                at = begin[size == n]
                a, b = np.triu_indices(n, 1)
                left, right = (at[:, None] + a).ravel(), (at[:, None] + b).ravel()
                two = (t[left, 1] == t[left, 2]) | (mine[left] != mine[right])  # within a block that meets another, pairs count elsewhere
                near = two & (np.bitwise_count(prints[left] ^ prints[right]).sum(1) <= most)
                np.add.at(sums, left[near], weight[right[near]])
                np.add.at(sums, right[near], weight[left[near]])
            for at, n in zip(begin[size > 24].tolist(), size[size > 24].tolist()):
                p, w, m = prints[at : at + n], weight[at : at + n], mine[at : at + n]
                one = t[at, 1] == t[at, 2]
                for i in range(0, n, 128):
                    near = np.bitwise_count(p[i : i + 128, None] ^ p[None]).sum(2) <= most
                    near &= np.arange(i, min(i + 128, n))[:, None] != np.arange(n)[None] if one else m[i : i + 128, None] != m[None]
                    sums[at + i : at + min(i + 128, n)] = near @ w
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[:, 4])), pa.array(sums)], names=["rep", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.stack([c.to_numpy() for c in batch.columns], 1)
            last = np.flatnonzero((t[:, :3] != t[-1, :3]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last lot may go on in the next batch
            if held and (cut or (held[-1][-1, :3] != t[0, :3]).any()):
                yield out(np.concatenate([*held, t[:cut]]))
                held, t = [], t[cut:]
            elif cut:
                yield out(t[:cut])
                t = t[cut:]
            held.append(t)
        if held:
            yield out(np.concatenate(held))

    rows = rows.select("root", F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), "mine", "rep", "weight", *BITS)
    found = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(tally, "rep bigint, n bigint")
    return found.groupBy("rep").agg(F.sum("n").alias("n"))


def duplicates(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, class_id, n_links): a row for each document that has a copy or a near-duplicate.

    ``class_id`` is the least doc_id of the class, ``n_links`` counts the
    other different texts of the class whose fingerprints are within ``most``
    bits (copies of a text are one). Documents that stand alone have no row:
    they are classes of one without links.

    Rows without an id can't be named and are left out, as are texts without
    a word (null, empty, symbols only). Rows that repeat an id and its text
    are one document; an id with several texts is a document for each, and so
    may have a row for each of their classes. Empty tables give no rows; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    members = materialize(fingerprint(rows).distinct(), "prints")
    texts = members.groupBy(*BITS, "text_hash").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    entries = texts.groupBy(*BITS).agg(F.min("least").alias("least"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("weight"))
    entries = materialize(entries.withColumn("rep", F.monotonically_increasing_id()), "entries")
    labelled = materialize(classes(entries, most), "classes")
    whole = labelled.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n_docs").alias("docs")).where("docs > 1")
    counted = labelled.join(whole, "root").join(links(labelled, most), "rep", "left")
    counted = counted.select(*BITS, "n_docs", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return _labels_of(members, materialize(counted, "labels")).select("doc_id", "class_id", "n_links").distinct()


def _labels_of(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the labels of their fingerprints (f0..f3, n_docs, ...).

    A fingerprint of many rows would make one large task of a join; those of
    more than 1/HOT of all rows, hence fewer than HOT, are broadcast instead.
    """
    total = labels.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hot, rest = labels.where(F.col("n_docs") * HOT > total), labels.where(F.col("n_docs") * HOT <= total)
    keys = hot.select(*BITS)
    cold = members.join(F.broadcast(keys), BITS, "left_anti").join(rest, BITS)
    return members.join(F.broadcast(hot), BITS).unionByName(cold)


def drop_duplicates(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each class, all columns as they are.

    Rows are judged by their own text, with or without an id: of a class the
    row of the least id stays (rows without one come last; of equal ids any
    one). So an id that stands for several texts keeps one row for each class
    of them, and rows that repeat id and text become one. Texts without a word
    all stay. Empty tables give empty tables.
    """
    (row,) = unused(docs.columns, "row_number")
    numbered = with_row_ids(docs, row, "numbered")
    slim = numbered.select(F.col(row).alias("row_number"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(fingerprint(slim), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_number")).alias("first")
    entries = prints.groupBy(*BITS).agg(first).withColumn("rep", F.monotonically_increasing_id())
    kept = classes(materialize(entries, "entries"), most).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_number").alias("row_number"))
    gone = materialize(prints.select("row_number").join(kept, "row_number", "left_anti"), "gone")
    return numbered.join(gone.withColumnRenamed("row_number", row), row, "left_anti").drop(row)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
