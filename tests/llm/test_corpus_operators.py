"""Operators over the whole corpus: mixing, near-duplicates, decontamination, page text, archives, the pipeline."""

import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import host_suffix_array, mixing, shard_table, simhash_index, warc_salvage, winnowing
from loomgraph.llm.words import WordHasher, text_chunks
from loomgraph.scratch import materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string, rep string, n string"
LABELS = "doc_id bigint, quality int, toxic int, text string"
ITEMS = "item_id bigint, text string, doc_id bigint"
PAGES = "page_id bigint, url string, html string, host string, text string"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def words(text):
    return re.findall(r"\w+", text.lower())


def random_text(rng, n, vocabulary=3000):
    return " ".join(f"w{i}x" for i in rng.integers(0, vocabulary, n))


def test_word_hashes_depend_on_the_word_alone():
    texts = ["Ab cd,ab", None, "", "AB", "é-É cd", "x" * 3_000_000]
    hasher, seen = WordHasher(), defaultdict(set)
    for begin, end, data, offsets in text_chunks(pa.array([t and t.lower() for t in texts]), most_bytes=7):
        h, s, e, first = hasher.words(data, offsets)
        for i in range(end - begin):
            for j in range(first[i], first[i + 1]):
                seen[bytes(data[s[j] : e[j]]).lower()].add(int(h[j]))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen) == 4


# ---- mixing


def mix_by_hand(docs, labels, shares, total):
    quality = {}
    for d, q, *_ in (x for x in labels if x[0] is not None):
        quality[d] = min(q, quality.get(d, q))
    import hashlib
    import math

    by, out = defaultdict(list), []
    for d, text, _, source in docs:
        n = len((text or "").split())
        u = (int(hashlib.md5(f"{mixing.SEED}|{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[source or ""].append((-math.log(u) / mixing.WEIGHTS[quality.get(d)], d if d is not None else -1, n, d))
    total = sum(r[2] for rows in by.values() for r in rows) if total is None else total
    shares = {s: 1.0 for s in by} if shares is None else {s: shares.get(s, 0.0) for s in by}
    for s, rows in by.items():
        budget, held = math.floor(total * (shares[s] / sum(shares.values()))), sum(r[2] for r in rows)
        epochs = budget // held if held else 0
        rest, run = budget - epochs * held, 0
        for key, _, n, d in sorted(rows):
            run += n
            copies = epochs + (rest > 0 and run <= rest)
            if copies:
                out.append((d, s, n, epochs, copies))
    return out


@pytest.mark.parametrize("shares, total", [(None, None), ({"a": 3, "b": 1}, 4000), ({"a": 1.0}, 100), (None, 0)])
def test_mixing_against_a_full_sort(spark, shares, total):
    rng = np.random.default_rng(2)
    docs = [(i, random_text(rng, int(rng.integers(0, 30))), None, ["a", "a", "a", "b", None][i % 5]) for i in range(300)] + [(None, "one two", None, "a"), (7, None, None, "b"), (8, "x y", None, "b"), (8, "x y", None, "b")]
    labels = [(i, i % 2) for i in range(0, 200, 3)] + [(3, 0), (None, 1)]
    got = mixing.mix_sources(frame(spark, docs), frame(spark, labels, LABELS), shares, total)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    have = sorted(((r["doc_id"], r["source"] or "", r["n_tokens"], r["epochs"], r["copies"]) for r in got.collect()), key=key)
    assert have == sorted(mix_by_hand(docs, labels, shares, total), key=key)
    again = mixing.repeat_copies(got, ["doc_id", "text", "source"])
    assert again.count() == sum(r[4] for r in have) and again.columns == ["doc_id", "text", "source"]
    assert mixing.mix_sources(frame(spark, []), frame(spark, labels, LABELS), shares, total).count() == 0
    assert mixing.mix_sources(frame(spark, docs), frame(spark, [], LABELS)).count() > 0


# ---- near-duplicates


def edited(rng, text, share):
    parts = text.split(" ")
    for i in range(len(parts)):
        if rng.random() < share:
            parts[i] = f"new{rng.integers(0, 10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    docs, groups = [], []
    for g in range(120):
        text, members = random_text(rng, int(rng.integers(60, 400))), []
        for k in range(1 + g % 4):
            docs.append((len(docs), text if k == 0 or g % 8 == 1 else edited(rng, text, 0.03)))
            members.append(len(docs) - 1)
        groups.append(members)
    return docs, groups


def prints_of(spark, docs):
    """(rep, f0..f3) of texts by id, and the fingerprints in numpy."""
    prints = simhash_index.fingerprint(frame(spark, docs).select(F.col("doc_id").alias("rep"), "text")).cache()
    rows = prints.collect()
    return prints, np.array([r["rep"] for r in rows]), np.array([[r[c] for c in simhash_index.BITS] for r in rows], np.int64).view(np.uint64)


def test_groups_of_near_duplicates(spark, corpus):
    docs, groups = corpus
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in simhash_index.duplicates(frame(spark, docs)).collect()}
    want = {m: g[0] for g in groups for m in g if len(g) > 1}
    assert set(got) <= set(want) and all(want[d] == c for d, (c, _) in got.items())
    assert len(got) >= 0.95 * len(want)
    _, ids, fps = prints_of(spark, docs)
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2) <= simhash_index.MAX_BITS
    texts, at = dict(docs), {d: i for i, d in enumerate(ids.tolist())}
    for d, (c, n) in got.items():  # every link to another text of the class counts, whether or not the index needed it
        assert n == len({texts[e] for e, (k, _) in got.items() if k == c and near[at[d], at[e]]} - {texts[d]})


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_links_in_blocks_against_brute_force(spark, block):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 4)
    fps = np.array([base ^ np.array([1 << int(b) for b in rng.integers(0, 40, 4)]) ^ (int(rng.integers(0, 2**20)) << 20) for _ in range(150)] + [rng.integers(0, 2**63, 4) for _ in range(60)], np.int64)
    root, weight = [0] * 150 + [150 + i // 3 * 3 for i in range(60)], rng.integers(1, 4, 210)
    rows = [(i, root[i], int(weight[i]), *map(int, fps[i])) for i in range(210)]
    got = {r["rep"]: r["n"] for r in simhash_index.links(spark.createDataFrame(rows, "rep bigint, root bigint, weight bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint"), most=46, block=block).collect()}
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None]).sum(2) <= 46
    want = {i: int(sum(weight[j] for j in range(210) if j != i and root[j] == root[i] and near[i, j])) for i in range(210)}
    assert got == want and sum(want.values()) > 1000


def test_pairs_against_brute_force(spark, corpus):
    docs = frame(spark, corpus[0])
    prints = simhash_index.fingerprint(docs.select("doc_id", "text")).groupBy(*simhash_index.BITS).agg(F.min("doc_id").alias("rep"))
    rows = prints.collect()
    fps = np.array([[r[c] for c in simhash_index.BITS] for r in rows], np.int64).view(np.uint64)
    ids = np.array([r["rep"] for r in rows])
    near = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
    want = {(min(a, b), max(a, b)) for a, b in zip(ids[np.nonzero(near <= simhash_index.MAX_BITS)[0]], ids[np.nonzero(near <= simhash_index.MAX_BITS)[1]]) if a != b}
    sure = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(near <= 15)) if i != j}
    got = {(r["a"], r["b"]) for r in simhash_index.candidate_edges(prints).collect()}
    assert got <= want and sure <= got and len(got) >= 0.9 * len(want)


def test_recall_in_each_band_of_distance(spark):
    rng = np.random.default_rng(7)
    docs = []
    for k in range(900):  # pairs of texts with 5 to 15 % of words replaced
        text = random_text(rng, int(rng.integers(100, 400)))
        docs += [(2 * k, text), (2 * k + 1, edited(rng, text, (0.05, 0.1, 0.15)[k % 3]))]
    prints = simhash_index.fingerprint(frame(spark, docs).select(F.col("doc_id").alias("rep"), "text"))
    at = {r["rep"]: np.array([r[c] for c in simhash_index.BITS], np.int64).view(np.uint64) for r in prints.collect()}
    got = {(r["a"], r["b"]) for r in simhash_index.candidate_edges(prints).collect()}
    far = np.array([int(np.bitwise_count(at[2 * k] ^ at[2 * k + 1]).sum()) for k in range(900)])
    hit = np.array([(2 * k, 2 * k + 1) in got for k in range(900)])
    assert not hit[far > simhash_index.MAX_BITS].any()
    for low, high in ((0, 29), (30, 35), (36, 40), (41, 43), (44, 46)):
        band = (far >= low) & (far <= high)
        assert band.sum() >= 20 and hit[band].mean() >= (1 if high <= 29 else 0.9), (low, high, band.sum(), hit[band].mean())


def test_large_group_and_edge_rows(spark):
    rng = np.random.default_rng(5)
    text = random_text(rng, 300)
    docs = [(i, text if i % 2 else edited(rng, text, 0.01)) for i in range(400)]
    other = random_text(rng, 100)
    docs += [(1000, None), (1001, ""), (1002, None), (1003, "?!"), (None, text), (None, text), (2000, "one only"), (2000, "one only"), (1, text), (3000, "long " + random_text(rng, 200_000, 50_000))]
    docs += [(2000, other), (None, "no id " + other[:200]), (None, "no id " + other[:200])]  # an id with two texts; rows without an id
    df = frame(spark, docs)
    got = {(r["doc_id"], r["class_id"]): r["n_links"] for r in simhash_index.duplicates(df).collect()}
    assert set(got) == {(i, 0) for i in range(400)}
    assert got[1, 0] == len({t for i, t in docs[:400]}) - 1  # copies of a text are one
    kept = simhash_index.drop_duplicates(df)
    assert kept.columns == df.columns
    have = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert [d for d, _ in have] == [-1, 0, 1000, 1001, 1002, 1003, 2000, 2000, 3000]
    assert {t for d, t in have if d == 2000} == {"one only", other} and have[0][1].startswith("no id ")
    assert simhash_index.duplicates(frame(spark, [])).count() == 0 and simhash_index.drop_duplicates(frame(spark, [])).count() == 0


def test_own_columns_of_the_names_used_inside_stay(spark):
    """Columns named like temporary ones come through every stage as they were."""
    names = ["row_number", "Row_Number_", "n_tokens", "weight", "epochs", "copies", "run", "nth", "slot_number", "shard_number", "rep", "root", "doc.x"]
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text if i < 3 else f"{i} " + random_text(np.random.default_rng(i), 30), "en", "ab"[i % 2], 5, *[f"{n}-{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    ok = lambda out: all(r[n] == f"{n}-{r['doc_id']}" for r in out.collect() for n in names)
    kept = simhash_index.drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 10 and ok(kept)
    for limit in (1 << 20, 0):
        clean = winnowing.drop_leaks(df, frame(spark, [(1, text)], ITEMS), broadcast_bytes=limit)
        assert clean.columns == df.columns and clean.count() == 9 and ok(clean)
    mixed = mixing.mixed_copies(df, frame(spark, [], LABELS))
    assert mixed.columns == df.columns and mixed.count() > 0 and ok(mixed)
    placed = shard_table.assign_shards(df, shard_table.shard_names(3), 101)
    assert placed.columns == [*df.columns, "slot", "shard"] and placed.count() == 12 and ok(placed)


def test_many_copies_of_a_row(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "b", 3 * mixing.RUN + 5), (3, "c", 0), (4, "d", None), (5, None, 1)], "doc_id bigint, text string, copies bigint")
    got = {r["doc_id"]: r["count"] for r in mixing.repeat_copies(rows, ["doc_id", "text"]).groupBy("doc_id").count().collect()}
    assert got == {1: 3, 2: 3 * mixing.RUN + 5, 5: 1}


def test_spanning_forest_and_components(spark):
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**63, (40, 4)).astype(np.uint64)
    fps[20:] = fps[:20] ^ np.uint64(7)
    assert len(simhash_index.near_edges(fps)) == 20
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 105), (99, 105)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in simhash_index.components(chain).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 100: 99, 101: 99, 105: 99}
    assert simhash_index.components(chain.where("false")).count() == 0


# ---- decontamination


def spans_by_hand(docs, items, least):
    found = set()
    for d, text in docs:
        w = words(text or "")
        for i, item in items:
            v = words(item or "")
            for a in range(len(w)):
                for b in range(len(v)):
                    if w[a] == v[b] and (a == 0 or b == 0 or w[a - 1] != v[b - 1]):
                        n = 0
                        while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                            n += 1
                        if n >= least:
                            found.add((d, i, a, b, n))
    return found


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_leaks_against_brute_force(spark, limit):
    rng = np.random.default_rng(7)
    items = [(i, random_text(rng, int(rng.integers(5, 60)), 60)) for i in range(12)] + [(20, None), (21, ""), (3, "repeated id with other words in it"), (None, "x")]
    docs = []
    for d in range(40):
        text = random_text(rng, int(rng.integers(0, 80)), 60)
        if d % 3 == 0:
            span = items[d % 12][1].split(" ")
            text += " " + " ".join(span[d % 4 : d % 4 + 8 + d % 12]).upper() + "! " + random_text(rng, 10)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    got = {tuple(r) for r in winnowing.leaks(frame(spark, docs), frame(spark, items, ITEMS), broadcast_bytes=limit).collect()}
    want = spans_by_hand(docs, [i for i in items if i[0] is not None], winnowing.K + winnowing.WINDOW - 1)
    assert got == want and len(got) > 5
    df = frame(spark, [*docs, (None, items[0][1] * 3), (None, "clean")])
    kept = winnowing.drop_leaks(df, frame(spark, items, ITEMS), broadcast_bytes=limit)
    bad = {r[0] for r in want}
    assert kept.columns == df.columns
    long_item = len(words(items[0][1])) >= winnowing.K + winnowing.WINDOW - 1
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([str(d) for d, _ in docs if d not in bad] + ["None"] * (1 if long_item else 2))
    assert winnowing.leaks(frame(spark, []), frame(spark, items, ITEMS), broadcast_bytes=limit).count() == 0
    assert winnowing.leaks(df, frame(spark, [], ITEMS), broadcast_bytes=limit).count() == 0
    assert winnowing.drop_leaks(df, frame(spark, [], ITEMS), broadcast_bytes=limit).count() == len(docs) + 2


def test_repetitive_texts_against_brute_force():
    rng = np.random.default_rng(12)
    for trial in range(120):
        base = rng.integers(0, 3 if trial % 2 else 50, int(rng.integers(1, 12))).tolist()
        doc = (base * 40)[: int(rng.integers(0, 90))] + rng.integers(0, 3, int(rng.integers(0, 30))).tolist() + (base * 9)[: int(rng.integers(0, 60))]
        if trial % 3 == 0 and doc:
            doc[int(rng.integers(0, len(doc)))] = 99
        items = [(base * 40)[int(rng.integers(0, 5)) : int(rng.integers(5, 70))], rng.integers(0, 2, 40).tolist(), doc[10:40]]
        hashes = lambda ws: np.array([w * 7919 + 13 for w in ws], np.uint64)
        bound = winnowing.Items(np.arange(3), hashes([w for i in items for w in i]), np.concatenate(([0], np.cumsum([len(i) for i in items]))), winnowing.K, winnowing.WINDOW)
        got = {tuple(r) for r in winnowing.find_hits(hashes(doc), np.array([0, len(doc)]), bound, winnowing.K, winnowing.WINDOW).tolist()}
        text = lambda ws: " ".join(f"w{w}" for w in ws)
        assert got == spans_by_hand([(0, text(doc))], [(i, text(t)) for i, t in enumerate(items)], 13)


def test_long_repetition_is_walked_once():
    import time

    start = time.perf_counter()
    one = np.full(20_000, 5, np.uint64)
    items = winnowing.Items(np.arange(1), one[:500], np.array([0, 500]), winnowing.K, winnowing.WINDOW)
    assert len(winnowing.find_hits(one, np.array([0, len(one)]), items, winnowing.K, winnowing.WINDOW)) == 20_000 + 500 - 2 * 13 + 1
    assert time.perf_counter() - start < 10


def test_scripts_without_spaces_have_a_word_per_character(spark):
    item = "这是一个用来测试的很长的句子没有任何空格"
    docs = frame(spark, [(1, "前面的字" + item + "后面的字"), (2, "完全不同的内容，没有共同的部分，一点也没有。"), (3, "ภาษาไทย")])
    assert [(r["doc_id"], r["n_words"]) for r in winnowing.leaks(docs, frame(spark, [(7, item)], ITEMS)).collect()] == [(1, len(item))]


def test_every_window_keeps_its_least_gram():
    rng = np.random.default_rng(8)
    sizes = [0, 3, 6, 7, 13, 14, 60]
    hashes = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    at, grams = winnowing.fingerprints(hashes, first)
    kept = set(at.tolist())
    assert not any(a < 3 for a in kept) and len(grams) == len(at)
    for lo, n in zip(first, sizes):
        spots = range(lo, lo + n - winnowing.K + 1)
        for w in range(max(0, len(spots) - winnowing.WINDOW + 1)) if len(spots) >= winnowing.WINDOW else [0] if len(spots) else []:
            assert kept & set(spots[w : w + winnowing.WINDOW])
    whole = winnowing.fingerprints(hashes[first[-2] :], np.array([0, 60]))
    assert set((whole[0] + first[-2]).tolist()) == {a for a in kept if a >= first[-2]}


# ---- pages


def clean_by_hand(pages, depth, least):
    """Tokens left on each page when windows on several pages of a host are removed."""
    where, texts = defaultdict(set), {}
    for i, (_, url, html) in enumerate(pages):
        host = (re.match(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "") or [None, ""])[1].lower()
        tokens = host_suffix_array.visible_text(html or "").split()
        texts[i] = host, tokens
        for a in range(len(tokens) - depth + 1):
            where[host, tuple(tokens[a : a + depth])].add(i)
    out = []
    for i, (host, tokens) in texts.items():
        gone = set()
        for a in range(len(tokens) - depth + 1):
            if len(where[host, tuple(tokens[a : a + depth])]) >= least:
                gone |= set(range(a, a + depth))
        out.append((pages[i][0], " ".join(t for a, t in enumerate(tokens) if a not in gone), len(tokens) - len(gone), len(gone)))
    return out


@pytest.mark.parametrize("lot, part", [(1 << 30, 1 << 30), (20_000, 50_000), (500, 1 << 20)])
def test_page_text_against_brute_force(spark, sf_dir, lot, part):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [(900, None, "<p>none</p>"), (901, "http://a.example/x", None), (902, "http://a.example/y", ""), (None, "http://B.example/z", "<p>" + "one two three four five six seven eight nine </p>"), (904, "http://b.example:80/", "<div>zero one two three four five six seven eight nine ten</div><script>x<y</script> tail")]
    pages += [(905, "http://c.example/", "<p>same page here with quite a few words in it"), (905, "http://c.example/", "<p>same page here with quite a few words in it")]
    shuffled = frame(spark, pages, PAGES).repartition(3, F.rand(4))  # rows whose order differs from run to run
    got = host_suffix_array.extract(shuffled, lot_bytes=lot, part_bytes=part)
    key = lambda r: tuple(map(str, r))
    have = sorted(((r["page_id"], " ".join(r["text"].split()), r["n_tokens"], r["n_removed"]) for r in got.collect()), key=key)
    assert have == sorted(clean_by_hand(pages, host_suffix_array.MIN_TOKENS, host_suffix_array.MIN_PAGES), key=key)
    assert sum(r[3] for r in have) > 100
    assert host_suffix_array.extract(frame(spark, [], PAGES), lot_bytes=lot, part_bytes=part).count() == 0


def test_windows_cover_all_maximal_common_substrings():
    rng = np.random.default_rng(10)
    pages = [rng.integers(0, 4, int(rng.integers(0, 60))).tolist() for _ in range(8)]
    texts = [" ".join(f"t{w}" for w in p) for p in pages]
    lot = host_suffix_array.Lot([""] * 8, texts, 5)
    _, number, count = lot.windows()
    gone, first = host_suffix_array.covered(lot.first, lot.at[(count >= 2)[number]], 5), lot.first
    want = [set() for _ in pages]
    for a, p in enumerate(pages):  # the common run at every two places, by comparison
        for b, q in enumerate(pages):
            for i in range(len(p) if a != b else 0):
                for j in range(len(q)):
                    n = 0
                    while i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n]:
                        n += 1
                    if n >= 5:
                        want[a] |= set(range(i, i + n))
    assert [set(np.flatnonzero(gone[lo:hi]).tolist()) for lo, hi in zip(first, first[1:])] == want and sum(map(len, want)) > 50


def test_ranks_to_any_depth():
    rng = np.random.default_rng(9)
    tokens = rng.integers(0, 3, 400).astype(np.uint64)
    for depth in (1, 2, 3, 5, 8, 11):
        rank = host_suffix_array.window_ranks(tokens, depth)
        assert len(rank) == 400 - depth + 1
        windows = [tuple(tokens[i : i + depth]) for i in range(len(rank))]
        order = {w: i for i, w in enumerate(sorted(set(windows)))}
        assert [order[w] for w in windows] == rank.tolist()


def test_visible_text():
    page = '<!DOCTYPE html><head><title>T</title></head><body><!-- no --><script>var t="</p>";</script><p title="a>b">One&amp;two<br>three <b>four</b></p><li>5 < 6<style>p{}</style>'
    assert host_suffix_array.visible_text(page).split() == ["One&two", "three", "four", "5", "<", "6"]


# ---- archives


def test_salvage_covers_every_byte():
    good = [warc_salvage.record("response", f"urn:page:{i}", f"http://x/{i}", b"block %d " % i * 50) for i in range(6)]
    zipped = [warc_salvage.member(g) for g in good]
    flipped = bytearray(zipped[1])
    flipped[len(flipped) // 2] ^= 1
    wrong = good[4].replace(b"block 4", b"clock 4", 1)
    data = b"junk" + zipped[0] + bytes(flipped) + zipped[2] + zipped[3][:20] + good[3] + b"\x1f\x8b\x08" * 3 + wrong + zipped[5] + b"tail"
    for step in (1 << 20, 7):
        warc_salvage.READ, keep = step, warc_salvage.READ
        try:
            rows = list(warc_salvage.salvage(io.BytesIO(data)))
        finally:
            warc_salvage.READ = keep
        assert [r[6]["warc-record-id"] for r in rows if r[0] == "record"] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>", "<urn:page:5>"]
        at = 0
        for _, start, size, *_ in rows:
            assert start == at or not size
            at += size
        assert at == len(data)
        assert {r[5].split(":")[0] for r in rows if r[0] == "gap"} >= {"no member or version line"}
    assert list(warc_salvage.salvage(io.BytesIO(b""))) == []
    assert [r[0] for r in warc_salvage.salvage(io.BytesIO(b"nothing here"))] == ["gap"]
    two = warc_salvage.member(good[0] + good[1])
    assert [r[0] for r in warc_salvage.salvage(io.BytesIO(two))] == ["record", "record"]


def saved(data):
    """Numbers of records and reasons of gaps, in order; every byte of the file is in one row."""
    rows, at = list(warc_salvage.salvage(io.BytesIO(data))), 0
    for r in rows:
        assert r[1] == at or not r[2]
        at += r[2]
    assert at == len(data)
    return [int(r[6]["warc-record-id"][10:-1]) if r[0] == "record" else r[5] for r in rows]


GOOD = [warc_salvage.record("response", f"urn:page:{i}", f"http://x/{i}", b"block %d " % i * 50) for i in range(6)]


def test_salvage_inside_members():
    zipped, many = warc_salvage.member, b"".join(GOOD)
    assert saved(zipped(many)) == [0, 1, 2, 3, 4, 5]
    assert saved(zipped(many.replace(b"block 3", b"clock 3", 1))) == [0, 1, 2, "wrong digest", 4, 5]
    assert saved(zipped(GOOD[0] + b"junk here " * 5 + GOOD[1])) == [0, "no version line", 1]
    torn = saved(zipped(many * 40)[:-300])
    assert torn[-1] == "torn member" and len(torn) > 100 and set(torn[:-1]) == {0, 1, 2, 3, 4, 5}
    for lone, want in ((GOOD[0], []), (GOOD[0] + GOOD[2], [0, 2])):  # damage to a lone record's member may be in its header
        checksum = bytearray(zipped(lone))
        checksum[-6] ^= 1
        assert saved(bytes(checksum) + zipped(GOOD[1])) == [*want, "bad member: wrong checksum", 1]
    bare = GOOD[0].replace(b"WARC-Block-Digest", b"X-Nothing-To-Check")
    unsure = bytearray(zipped(bare))
    unsure[-6] ^= 1
    assert saved(bytes(unsure) + zipped(bare)) == ["bad member: wrong checksum", 0]
    assert saved(zipped(b"")) == ["empty member"] and saved(zipped(bytes(1 << 20))) == ["no version line"]


def test_salvage_of_unusual_headers():
    import base64
    import hashlib

    digest = hashlib.sha1(b"block 0 " * 50)
    hexed = GOOD[0].replace(base64.b32encode(digest.digest()), digest.hexdigest().encode())
    assert hexed != GOOD[0] and saved(hexed) == [0]
    assert saved(GOOD[0].replace(b"WARC-Date: ", b"X-Folded: a\r\n  b c\r\nWARC-Date: ")) == [0]
    assert saved(GOOD[0].replace(b"WARC-Date: ", b"X-Long: " + b"a" * 300_000 + b"\r\nWARC-Date: ") + GOOD[1]) == [0, 1]


def test_salvage_time_is_linear():
    import time

    start = time.perf_counter()
    false = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5000000\r\n\r\n" + b"x" * 25_000
    for junk, good in ((false * 400, GOOD[2]), (b"WARC/1.0\r\n" * 20_000, GOOD[2]), (b"\x1f\x8b\x08" * 20_000, warc_salvage.member(GOOD[2]))):
        got = saved(junk + good)
        assert len(got) == 2 and got[1] == 2 and got[0]
    assert time.perf_counter() - start < 20


def test_pages_of_other_encodings(spark, tmp_path):
    block = lambda body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    bodies = ["grün".encode(), "grün".encode("latin-1"), b"\xff\xfe\x00\x01", b""]
    (tmp_path / "a.warc").write_bytes(b"".join(warc_salvage.record("response", f"urn:page:{i}", "", block(b)) for i, b in enumerate(bodies)) + warc_salvage.record("warcinfo", "urn:x", "", b"software: y"))
    rows = warc_salvage.pages_from(warc_salvage.read_archives(spark, [f"file://{tmp_path}/a.warc"])).collect()
    assert [(r["page_id"], r["html"]) for r in rows] == [(0, "grün"), (1, "gr\ufffdn"), (2, rows[2]["html"]), (3, ""), (None, "software: y")]
    assert [r["raw"] and bytes(r["raw"]) for r in rows] == [None, bodies[1], bodies[2], None, None]


def test_written_archives_come_back(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    extra = [(None, None, None), (7777, "http://x\r\ny/", ""), (7778, "http://z/", "x" * 3_000_000), (7778, "http://z/", "ü" * 10)]
    pages = pages.unionByName(frame(spark, extra, PAGES).select("page_id", "url", "html")).coalesce(2)
    files = warc_salvage.write_archives(pages, f"file://{tmp_path}/clean", file_bytes=50_000)
    assert len(files) > 2
    back = warc_salvage.pages_from(warc_salvage.read_archives(spark, files))
    assert back.where("kind = 'gap'").count() == 0
    key = lambda r: tuple(map(str, r))
    want = sorted(((r[0], r[1] and r[1].replace("\r", " ").replace("\n", " "), r[2] or "") for r in pages.collect()), key=key)
    assert sorted((tuple(r) for r in back.select("page_id", "url", "html").collect()), key=key) == want
    files = warc_salvage.write_archives(pages, f"file://{tmp_path}/bad", faults=True, file_bytes=50_000)
    rows = warc_salvage.pages_from(warc_salvage.read_archives(spark, files)).collect()
    faults = {r[0]: warc_salvage.fault_of(warc_salvage.page_record_id(r[0])) for r in pages.collect()}
    assert sorted(str(r["page_id"]) for r in rows if r["kind"] == "record") == sorted(str(w[0]) for w in want if faults[w[0]] != "flip")
    assert sum(r["kind"] == "gap" for r in rows) >= 1 and "flip" in faults.values()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["file"]] += r["size"]
    assert all(n == (tmp_path / "bad" / f.rsplit("/", 1)[1]).stat().st_size for f, n in sizes.items()) and len(sizes) == len(files)
    assert warc_salvage.read_archives(spark, []).count() == 0 and warc_salvage.write_archives(pages.where("false"), f"file://{tmp_path}/none") == []


# ---- pipeline


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, materialize(stage(spark, at, sf_dir), name)
        seen[name] = at
        if name != "sharding":
            assert at.columns == columns
        if name == "near_dedup":
            gone = {r["doc_id"] for r in simhash_index.duplicates(before).collect()}
            assert {r["doc_id"] for r in at.collect()} == {r["doc_id"] for r in before.collect()} - gone and gone
        if name == "decontamination":
            bad = {r["doc_id"] for r in winnowing.leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in at.collect()} == {r["doc_id"] for r in before.collect()} - bad and bad
        if name == "mixing":
            rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before.collect()]
            labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
            want = [d for d, _, _, _, n in mix_by_hand(rows, labels, None, None) for _ in range(n)]
            assert sorted(r["doc_id"] for r in at.collect()) == sorted(want)
        if name == "sharding":
            assert at.count() == before.count() and {"slot", "shard"} <= set(at.columns)
    run = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["doc_id"], r["shard"])
    assert sorted(map(key, run.collect())) == sorted(map(key, seen["sharding"].collect()))
    assert zlib.crc32(b"") == 0
