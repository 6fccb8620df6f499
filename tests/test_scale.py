"""What keeps queries in proportion to their tables: what they build, where work is cut, how pairs are made."""

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.graph import Later, make_graph
from loomgraph.operators import calls, fields, listing, resolve
from loomgraph.plans import catalog, projection
from loomgraph.sources.scan import content_hash
from tests.graphs import build


@pytest.fixture
def fresh(spark, monkeypatch):
    """A session that has stored no graph; lists the tables that are stored since."""
    made = []
    monkeypatch.setattr(projection, "_stored", {})
    monkeypatch.setattr(projection, "materialize", lambda df, tag: made.append(tag) or df)
    return made


@pytest.mark.parametrize("name, tables", [("B11_confidence", {"edges"}), ("B8_public", {"nodes"}), ("H15_range_lines", {"nodes"}), ("C4_name_parts", {"nodes"}), ("F4_in_degree", {"edges"}), ("G13_references", {"refs", "files"}), ("B12_receiver", {"refs"})])
def test_a_query_stores_the_tables_that_it_reads(spark, sf_dir, fresh, name, tables):
    catalog.QUERIES[name](spark, sf_dir).count()
    assert set(fresh) == tables


def test_a_table_is_made_once_when_it_is_read(spark):
    made = []
    g = make_graph(spark).with_tables(nodes=Later(lambda: made.append(1) or spark.range(3)))
    h = g.with_tables(edges=spark.range(1))
    assert g.spark is not None and not made
    assert h.nodes.count() == g.nodes.count() == h.nodes.count() == 3 and len(made) == 1


def test_rows_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.graph.TASK_ROWS", 10)
    from loomgraph.graph import spread

    parts = spread(spark.range(100), "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 3 and sum(r["count"] for r in parts) == 100


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_name_parts_are_taken_of_different_names_only(spark, sf_dir):
    df = catalog.QUERIES["C4_name_parts"](spark, sf_dir)
    assert df.inputFiles() and all("/names-" in f for f in df.inputFiles())


def test_receivers_are_judged_by_different_names(spark, sf_dir):
    df = catalog.QUERIES["B12_receiver"](spark, sf_dir)
    assert "/names-" in "".join(df.inputFiles()) and df.count() == 8


def test_similarity_is_made_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fields, "BLOCK", 3)
    monkeypatch.setattr(fields, "TASK_PAIRS", 5)
    uses = [(m, f, (m * 7 + k) % 3 == 0) for m in range(1, 41) for k, f in enumerate("abcde") if (m >> k) % 2 or m % 4 == 0 and f == "a"]
    refs = [(1, "field_access", f, 1, 0, m, None, None, None, "this_member_write" if write else "this_member_read") for m, f, write in uses]
    g = build(spark, [(1, "a.py", "python")], [], [], refs)
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in fields.similarity(g, spark.range(1, 41).select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("container"))).collect()}
    of = {m: {f: 1.0 if w else 0.3 for n, f, w in uses if n == m} for m in range(1, 41)}
    want = {}
    for a in of:
        for b in of:
            if a < b and a % 2 == b % 2 and set(of[a]) & set(of[b]):
                low = sum(min(of[a][f], of[b][f]) for f in set(of[a]) & set(of[b]))
                want[a, b] = round(low / (sum(of[a].values()) + sum(of[b].values()) - low), 9)
    assert got == want


def test_call_sites_are_found_once(spark, sf_dir):
    g = projection.project(spark, sf_dir)
    scored = calls.callsite_scores(g, catalog.PART)
    assert any("/sites-" in f for f in scored.inputFiles()) and not any("/refs-" in f for f in scored.inputFiles())
    one = spark.createDataFrame([(3,)], "file_id bigint")
    got = {tuple(r) for r in calls.included_files(g, one).collect()}
    assert got == {tuple(r) for r in calls.included_files(g).where("from_file = 3").collect()} and len(got) == 1


def test_files_are_joined_to_what_a_search_finds(spark, sf_dir):
    g = projection.project(spark, sf_dir)
    assert plan(listing.symbol_hits(g, "Widget")).count("Join LeftOuter") == 1


def test_words_come_before_substrings_while_they_are_few(spark):
    g = build(spark, [(1, "a.py", "python")], [(i, "function", n, n, 1, 1, 2) for i, n in enumerate(["openBook", "reopen", "Open", "closed", "re_open"], 1)], [])
    assert {(r["name"], r["bucket"]) for r in listing.symbol_hits(g, "open").collect()} == {("openBook", 0), ("Open", 0), ("re_open", 0), ("reopen", 1)}
    many = build(spark, [(1, "a.py", "python")], [(i, "function", n, n, 1, 1, 2) for i, n in enumerate(["open"] * 5 + ["reopen"], 1)], [])
    assert {r["bucket"] for r in listing.symbol_hits(many, "open").collect()} == {0}


def test_calls_meet_the_choices_of_their_name(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(resolve, "materialize", lambda df, tag: kept.setdefault(tag, df))
    symbols = [(10 + i, "function", n, n, f, 1, 2) for i, (n, f) in enumerate([("draw", 1), ("draw", 2), ("draw", 3), ("a.draw", 4), ("other", 1)])]
    refs = [(f, "call", n, 1, 0) for f in (1, 2, 4) for n in ("draw", "a.draw", "b.draw", "c.draw", "none")]
    g = build(spark, [(i, f"src/{i}.py", "python") for i in range(1, 5)], symbols, [], refs)
    names = {r["id"]: (r["file_id"], r["name"]) for r in g.refs.collect()}
    got = {names[r["ref_id"]]: r["target"] for r in resolve.resolve_calls(g).collect()}
    draw = lambda f: 11 if f == 1 else 10
    assert got == {(f, n): 13 if n == "a.draw" and f != 4 else draw(f) for f in (1, 2, 4) for n in ("draw", "a.draw", "b.draw", "c.draw")}
    assert kept["choices"].count() == 4  # one row a name, of twelve calls


def test_calls_of_a_name_language_and_root_are_resolved_across_roots_once(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(resolve, "materialize", lambda df, tag: kept.setdefault(tag, df))
    files = [(i, f"src/{i}.py", "python" if i < 3 else None) for i in range(1, 5)]
    symbols = [(2 * 10**9 + 1, "function", "draw", "Pen.draw", 1, 1, 2), (2 * 10**9 + 2, "function", "draw", "Ink.draw", 1, 3, 4)]
    g = build(spark, files, symbols, [], [(f, "call", n, 1, 0) for f in (1, 2, 3, 4) for n in ("ink.draw", "draw")])
    names = {r["id"]: (r["file_id"], r["name"]) for r in g.refs.collect()}
    got = {names[r["ref_id"]]: (r["target"] % 10, round(r["confidence"], 2)) for r in resolve.cross_root(g, 2).collect()}
    assert got == {(1, "draw"): (1, 0.75), (2, "draw"): (1, 0.75), (1, "ink.draw"): (2, 1.0), (2, "ink.draw"): (2, 1.0), (3, "ink.draw"): (2, 0.85), (4, "ink.draw"): (2, 0.85)}
    assert kept["alike"].count() == 4  # of eight calls


def test_in_degrees_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.graph.TASK_ROWS", 4)
    g = build(spark, [], [], [(n, n % 20, "calls", 1.0) for n in range(40)])
    assert listing.in_degrees(g).rdd.getNumPartitions() == 10 and {r["cnt"] for r in listing.in_degrees(g).collect()} == {2}


def test_files_are_joined_to_entry_points_only(spark, sf_dir):
    g = projection.project(spark, sf_dir)
    lines = plan(listing.entrypoints(g)).split("\n")
    at = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert "\n".join(lines).count("Join LeftOuter") == 1 and any("Join Inner" in line for line in lines[at:])


def test_references_are_joined_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.graph.TASK_ROWS", 4)
    refs = [(1 + n % 2, "call", f"f{n % 5}", 1, 0, 10 + n % 3) for n in range(40)]
    g = build(spark, [(1, "a.py", "python"), (2, "b.py", "python")], [(10, "method", "m", "m", 1, 1, 9), (11, "method", "k", "k", 1, 1, 9)], [], refs)
    df = catalog._held(g)
    assert df.rdd.getNumPartitions() == 10 and sum(r["n"] for r in df.collect()) == 40 and {(r["path"], r["holder"]) for r in df.collect()} == {(p, h) for p in ("a.py", "b.py") for h in ("m", "k", None)}


def test_hashes_read_arrow_buffers(spark):
    rows = [(1, b""), (2, None), (3, b"\x00\xff" * 1000), (4, "äö".encode())]
    df = spark.createDataFrame(rows, "id int, content binary").select("id", content_hash("content").alias("h"))
    assert "SQL_SCALAR_ARROW_UDF" in plan(df) or ", 250" in plan(df)  # no column of Python objects
    assert {r["id"]: r["h"] for r in df.collect()} == {i: None if b is None else xxhash.xxh3_64_hexdigest(b) for i, b in rows}
