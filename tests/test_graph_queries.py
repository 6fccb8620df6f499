"""Query tools on small graphs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.adapters import tools
from loomgraph.graph import current_version, kv_get, kv_put, load, make_graph, save
from loomgraph.operators import calls, context, fields, listing, maintain, text, traverse
from loomgraph.operators.paging import budget_prefix, page, page_meta, select_fields
from loomgraph.schema import InvalidInput, NotFound
from tests.graphs import drawing, build, call_sites


@pytest.fixture(scope="module")
def shapes(spark):
    return drawing(spark)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_listings(shapes):
    assert listing.repo_stats(shapes).first()[:3] == (5, 13, 15)
    assert column(listing.file_search_page(shapes, "*.cpp"), "path") == ["src/circle.cpp", "src/main.cpp", "src/square.cpp", "src/util/rounding.cpp"]
    assert set(column(listing.dir_list(shapes, "src"), "path")) == {"src/shape.h", "src/square.cpp", "src/circle.cpp", "src/main.cpp", "src/util/"}
    tree = {r["path"]: (r["type"], r["children_count"], r["truncated"]) for r in listing.dir_tree(shapes, ".", 2).collect()}
    assert tree["src"] == ("dir", 5, False) and tree["src/util"] == ("dir", 1, True) and tree["src/square.cpp"][0] == "file"
    capped = listing.cap_tree(listing.dir_tree(shapes, ".", 3), 4)
    assert capped.where("type = 'file'").count() <= 4
    rows = listing.symbols_in_path(shapes, "src/square.cpp")
    assert column(listing.symbol_list(rows), "name") == ["Square", "area", "rotate"]
    assert listing.symbol_list_meta(rows, 10).first()["total_candidates"] == 3
    with pytest.raises(NotFound):
        listing.symbols_in_path(shapes, "nowhere")
    assert listing.resolve_file(shapes, "square.cpp") == "src/square.cpp" and listing.resolve_file(shapes, "src/square.cpp") == "src/square.cpp"
    assert column(listing.file_overview(shapes, "src/square.cpp").orderBy("start_line"), "name") == ["Square", "area", "rotate"]
    assert {(r["name"], r["reason"]) for r in listing.entrypoints(shapes, limit=1).collect()} == {("main", "main_function"), ("Shape", "high_in_degree")}
    assert column(listing.find_implementations(shapes, "Shape"), "name") == ["Square", "Circle"]


def test_search_by_words_of_names(spark):
    g = build(spark, [(1, "test.cpp", "cpp")], [(10, "function", "calculateDistance", "math::calculateDistance", 1, 1, 2), (11, "function", "calculateArea", "math::calculateArea", 1, 3, 4), (12, "function", "SyncPod", "kube::SyncPod", 1, 5, 6), (13, "struct", "Point", "math::Point", 1, 7, 8), (14, "class", "Line", "math::Line", 1, 9, 9)], [])
    names = lambda q, **o: column(listing.symbol_search(g, q, **o), "name")
    assert names("calculate") == ["calculateArea", "calculateDistance"] and names("Sync") == ["SyncPod"] and names("dist") == ["calculateDistance"]
    assert names("math") == ["Line", "Point", "calculateArea", "calculateDistance"]
    assert names("*", kind="struct") == ["Point"] and len(names("")) == 6 and names('a"b') == []
    assert names("alcul") == ["calculateArea", "calculateDistance"]


def test_edges(shapes):
    assert column(calls.callers_page(shapes, 13), "caller_name") == ["main"]
    assert column(calls.callees_page(shapes, 16), "callee_name") == ["area", "radius", "round_off"]
    assert {r["group"]: r["n"] for r in calls.grouped(calls.callees(shapes, 16), "module", "callee_name").collect()} == {"src": 2, "src/util": 1}
    assert {(r["direction"], r["path"]) for r in traverse.file_deps(shapes, "src/shape.h").collect()} == {("included_by", "src/square.cpp"), ("included_by", "src/circle.cpp")}
    impact = traverse.impact_of(shapes, 10, depth=3)
    assert {(r["name"], r["distance"]) for r in impact.collect()} == {("Square", 1), ("Circle", 1)}
    sub = traverse.subgraph(shapes, [16], 2, ["calls"])
    assert set(column(sub["nodes"], "name")) == {"main", "area", "radius", "round_off"} and sub["edges"].count() == 3
    assert traverse.subgraph(shapes, [16], 1, [])["edges"].count() == 0
    with pytest.raises(InvalidInput):
        traverse.subgraph(shapes, [16], 1, ["nonsense"])
    path = traverse.shortest_path(shapes, 16, 10).orderBy("path_no", "step")
    assert column(path, "name") == ["main", "area", "Square", "Shape"] and column(path, "edge_kind") == ["calls", "contains", "inherits", None]
    two = traverse.shortest_path(shapes, 16, 10, max_paths=2)
    assert set(column(two.where("path_no = 2"), "name")) == {"main", "radius", "Circle", "Shape"}
    assert traverse.shortest_path(shapes, 16, 16).count() == 0 and traverse.shortest_path(shapes, 17, 10, relation_types=["inherits"]).count() == 0


def test_context(shapes, spark):
    sources = spark.createDataFrame([("src/square.cpp", "\n".join(f"line {i}" for i in range(1, 40)))], "path string, text string")
    got = context.context_for(shapes, symbol="area", file="square.cpp", sources=sources)
    assert got["symbol"].first()["source"] == "\n".join(f"line {i}" for i in range(8, 15))
    assert column(got["callers"], "caller_name") == ["main"] and column(got["container"], "name") == ["Square"] and column(got["siblings"], "name") == ["rotate"] and column(got["base_types"], "name") == ["Shape"]
    assert column(context.context_by_name(shapes, "round")["symbol"], "name") == ["round_off"]
    assert "candidates" in context.context_by_name(shapes, "nothing")
    ids = [r["node_id"] for r in context.symbol_get(shapes, [15, 99, 13]).orderBy("pos").collect()]
    assert ids == [15, 13]


def test_candidates_by_receiver(spark):
    got = {(r["callee_text"], r["start_line"]): (round(r["confidence"], 2), r["heuristic"]) for r in calls.callsite_candidates(call_sites(spark), 11).collect()}
    assert got[("OrderBook.set", 6)] == (0.90, "receiver_exact_target_owner")
    assert got[("stray.set", 7)] == (0.30, "unrelated_member_suffix_match") and got[("PriceList.set", 8)][0] == 0.30
    assert list(got)[0] == ("OrderBook.set", 6) and len(got) == 5
    only = calls.callsite_candidates(call_sites(spark), 11, receiver="OrderBook")
    assert column(only, "callee_text") == ["OrderBook.set"]
    assert calls.callsite_candidates(call_sites(spark), 11, limit=0).count() == 0


def test_candidates_by_type_and_arity(spark):
    g = call_sites(spark, hints={0: "OrderBook", 3: "PriceList"}, args={0: (2, "string,number"), 2: (2, "string,number"), 3: (5, "")}, signature="set(key: string, value: number): void")
    got = {(r["callee_text"]): (round(r["confidence"], 2), r["heuristic"]) for r in calls.callsite_candidates(g, 11).collect()}
    assert got["orders.set"] == (0.99, "cross_file_receiver_type_exact+arity_match+arg_pattern")
    assert got["OrderBook.set"] == (0.99, "receiver_exact_target_owner+arity_match+arg_pattern") and "stray.set" not in got
    buckets = calls.candidate_buckets(calls.callsite_scores(g, 11))
    assert {r["value"]: r["n"] for r in buckets["arity"].collect()} == {"2": 2, "unknown": 2}


def test_callers_modes(spark):
    g = call_sites(spark, extra=30)
    assert "candidate_results" in calls.callers_approx(g, 11) and "candidate_results" not in calls.callers_approx(g, 11, mode="exact")
    assert "candidate_results" not in calls.callers_approx(call_sites(spark, exact=True), 11)
    assert column(calls.callers_page(g, 13), "caller_name") == ["closeBook"]
    small = calls.callsite_candidates(g, 11, max_bytes=1200)
    assert 1 <= small.count() < 20
    meta = calls.candidate_meta(g, 11, calls.callsite_scores(g, 11), 20).first()
    assert meta["candidate_total"] == 35 and meta["filtered_hidden"] == 15
    assert calls.callers_lean(g, 13).columns == ["file", "line", "caller", "confidence"]


def test_change_impact(spark):
    files = [(i, f"src/{n}.cpp", "cpp") for i, n in enumerate("abcd", 1)]
    symbols = [(10 + i, "function", n, n, i + 1, 1, 3) for i, n in enumerate(["foo", "bar", "baz", "low"])]
    g = build(spark, files, symbols, [(11, 10, "calls", 0.9), (12, 11, "calls", 0.8), (13, 10, "calls", 0.3)])
    changed = spark.createDataFrame([("src/a.cpp",)], "path string")
    assert [(r["name"], r["distance"]) for r in traverse.detect_changes(g, changed).collect()] == [("bar", 1), ("baz", 2)]
    assert column(traverse.detect_changes(g, changed, depth=1, min_confidence=0.2), "name") == ["bar", "low"]
    assert traverse.detect_changes(g, changed, file_pattern="*.h").count() == 0
    s = traverse.change_summary(changed, traverse.changed_symbols(g, changed), traverse.detect_changes(g, changed)).first()
    assert tuple(s) == (1, 1, 2, 2)


def test_lean_listing_budget(spark):
    symbols = [(10, "type_alias", "ID", "ID", 1, 1, 1, None, "public"), (11, "type_alias", "Props", "Props", 1, 2, 2, None, "public"), (12, "type_alias", "LocalPrivate", "LocalPrivate", 1, 3, 3, None, "private"), (13, "type_alias", "LongOptions", "LongOptions", 1, 10, 15, None, "public")]
    symbols += [(20 + i, "function", f"fn{i}", f"fn{i}", 1, 100 + i, 104 + i, None, "public") for i in range(200)]
    g = build(spark, [(1, "src/types.ts", "typescript")], symbols, [])
    rows = listing.candidates_of(g, ["type_alias"])
    assert column(listing.symbol_list(rows, min_span_lines=3), "name") == ["ID", "Props", "LongOptions"]
    m = listing.symbol_list_meta(rows, 3).first()
    assert (m["total_candidates"], m["total"], m["filtered_hidden"], m["hidden_public_count"]) == (4, 3, 1, 0)
    part = listing.symbol_list(listing.candidates_of(g, path="src/types.ts"), max_bytes=2000)
    assert 5 < part.count() < 204
    assert listing.symbol_list(listing.candidates_of(g, path="src/types.ts"), max_bytes=1, handles=True).columns[0] == "node_id"
    with pytest.raises(InvalidInput):
        select_fields(rows, ["nonsense"])
    assert select_fields(rows, ["name", "span"]).first()["span"] == [1, 1]


def test_pages(spark):
    df = spark.range(10)
    assert column(page(df, [F.col("id")], 3, 4), "id") == [4, 5, 6]
    assert tuple(page_meta(df, 3, 4).first()) == (10, True, 7) and tuple(page_meta(df, 3, 8).first()) == (10, False, None)
    assert column(budget_prefix(df, [F.col("id")], F.lit(100).cast("bigint"), 50), "id") == [0]
    assert column(budget_prefix(df, [F.col("id")], F.lit(100).cast("bigint"), 600), "id") == [0, 1]


def test_fields_and_clusters(spark):
    read, write = "this_member_read", "this_member_write"
    refs = [(1, "field_access", f, 5, 0, m, None, None, None, e) for m, f, e in [(11, "a", read), (11, "b", write), (12, "a", read), (12, "b", read), (13, "c", write), (13, "d", read), (14, "c", read), (14, "d", write), (15, "z", read)]]
    refs += [(1, "call", "this.two", 6, 0, 11), (1, "call", "other", 7, 0, 11)]
    g = build(spark, [(1, "a.ts", "typescript")], [(10, "class", "K", "K", 1, 1, 90)] + [(11 + i, "method", n, n, 1, 10 * (i + 1), 10 * (i + 1) + 5) for i, n in enumerate(["one", "two", "three", "four", "five"])], [(10, 11 + i, "contains", 1.0) for i in range(5)], refs)
    assert {(r["name"], r["relationship"]) for r in fields.method_calls(g, 11).collect()} == {("two", "self"), ("other", "external")}
    sims = {(r["a"], r["b"]): round(r["similarity"], 3) for r in fields.similarity(g).collect()}
    assert sims == {(11, 12): round(0.6 / 1.3, 3), (13, 14): round(0.6 / 2.0, 3)}
    got = fields.dependency_clusters(g).orderBy("node_id").collect()
    assert [(r["name"], r["shared_fields"]) for r in got] == [("one", "a,b"), ("two", "a,b"), ("three", "c,d"), ("four", "c,d")]
    assert {r["node_id"]: r["extractability"] for r in fields.extractability(g).collect()}[11] == 0.5


def test_text(spark):
    body = "int main() {\n  return confidence;\n}\n\nx\n// Confidence again\n"
    g = build(spark, [(1, "a.cpp", "cpp"), (2, "b.py", "python")], [], [])
    texts = spark.createDataFrame([("a.cpp", body), ("b.py", "confidence = 1\n" * 30)], "path string, text string")
    g = g.with_tables(lines=text.index_lines(g, texts))
    assert column(g.lines.where("file_id = 1").orderBy("line_no"), "line_no") == [1, 2, 6]
    assert text.code_search(g, "confidence").count() == 22 and text.code_search(g, "Confidence", case_sensitive=True).count() == 1
    one = text.code_search(g, "return", context_lines=1).first()
    assert one["text"] == "1: int main() {\n2:   return confidence;" and one["match_count"] == 1
    assert text.code_search(g, "confidence", file_pattern="*.py", limit=1).count() == 20
    with pytest.raises(InvalidInput):
        text.code_search(g, "ab")
    assert text.source_at(texts, "a.cpp", 1, 2).first()["source"] == "int main() {\n  return confidence;\n"
    for bad in ((0, 1), (3, 2), (1, 600)):
        with pytest.raises(InvalidInput):
            text.source_at(texts, "a.cpp", *bad)
    with pytest.raises(NotFound):
        text.source_at(texts, "none", 1, 2)
    tracked = spark.createDataFrame([(1,)], "file_id bigint")
    assert set(column(text.index_lines(g, texts, tracked), "file_id")) == {2}


def test_search_of_long_lines(spark):
    g = build(spark, [(1, "a.cpp", "cpp")], [], [])
    long = "x = 1; " * 40 + "Worthless tail"
    body = f"{long}\nworthless short\n{'worthless ' * 30}end\nother\n"
    g = g.with_tables(lines=text.index_lines(g, spark.createDataFrame([("a.cpp", body)], "path string, text string")))
    assert [(r["line"], r["text"], r["match_count"]) for r in text.code_search(g, "worthless").orderBy("line").collect()] == [(i + 1, body.split("\n")[i], 3) for i in range(3)]
    assert text.code_search(g, "Worthless", case_sensitive=True, context_lines=1).first()["text"] == f"1: {long}\n2: worthless short"
    assert text.match_counts(text.code_hits(g, "tail")).first()["match_count"] == 1
    assert max(len(c) for c in column(g.lines, "content")) == 200
    old = g.with_tables(lines=g.lines.withColumn("full_line", F.lit(None).cast("string")))
    assert column(text.code_search(old, "short"), "text") == ["worthless short"]


def test_store_and_doctor(shapes, spark, tmp_path):
    where = f"file://{tmp_path}/store"
    assert current_version(spark, where) == 0
    assert save(shapes, where) == 1 and save(shapes, where) == 2
    back = load(spark, where)
    assert back.edges.count() == 15 and back.files.columns == shapes.files.columns
    bad, counts, code = maintain.doctor(back)
    assert code == 0 and {r["table"]: r["n"] for r in counts.collect()}["nodes"] == 13
    broken = shapes.with_tables(nodes=shapes.nodes.where("id <> 16"))
    assert maintain.doctor(broken)[2] == 1 and set(column(maintain.violations(broken), "check")) == {"edges.src_id -> nodes", "edges.dst_id -> nodes"}
    with pytest.raises(InvalidInput):
        load(spark, f"file://{tmp_path}/none")
    kv = kv_put(kv_put(shapes.kv, {"a": "1", "b": "2"}), {"a": "3"})
    assert kv_get(kv, "a") == "3" and kv_get(kv, "b") == "2" and kv_get(kv, "c", "d") == "d"


def test_json_tools(shapes, spark, tmp_path, capsys):
    out = tools.call(shapes, "callers_approx", {"symbol": "area"})
    assert out["results"][0]["caller_name"] == "main"
    msg = lambda method, **params: json.loads(tools.answer(shapes, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    assert msg("initialize")["result"]["serverInfo"]["name"] == "loomgraph"
    assert len(msg("tools/list")["result"]["tools"]) >= 28
    assert "main" in msg("tools/call", name="callers_approx", arguments={"node_id": 13})["result"]["content"][0]["text"]
    assert msg("tools/call", name="callers_approx", arguments={"symbol": "none"})["error"]["code"] == -32000
    assert msg("tools/call", name="nothing")["error"]["data"]["error_code"] == "invalid_input"
    assert msg("nothing")["error"]["code"] == -32601 and json.loads(tools.answer(shapes, "{"))["error"]["code"] == -32700
    assert tools.answer(shapes, '{"method": "initialized"}') is None
    save(shapes, f"file://{tmp_path}/s")
    assert tools.main(["query", f"file://{tmp_path}/s", "repo_stats"]) == 0 and json.loads(capsys.readouterr().out)["counts"][0]["file_count"] == 5
    assert tools.main(["query", "x", "nothing"]) == 2 and tools.main([]) == 1
    assert tools.server_info(shapes)["schema_version"] == 8


def test_workspace(spark):
    main = build(spark, [(1, "app.py", "python")], [(2, "function", "runApp", "runApp", 1, 1, 3)], [(1001, 2, "contains", 1.0)], [(1, "call", "findLedger", 2, 0, 2)])
    other = make_graph(
        spark, files=spark.createDataFrame([(1, "src/lib.py", "python")], "id bigint, path string, language string"),
        nodes=spark.createDataFrame([(1, "file", None, "file", "src/lib.py", "src/lib.py::file", None, None, 1), (2, "symbol", 1, "function", "findLedger", "k", 1, 3, 1)], "id bigint, node_type string, file_id bigint, kind string, name string, stable_key string, start_line int, end_line int, is_definition int"),
        edges=spark.createDataFrame([(1, 2, 2, "references", 1.0), (2, 1, 2, "contains", 1.0)], "id bigint, src_id bigint, dst_id bigint, kind string, confidence double"),
        refs=spark.createDataFrame([(1, 1, "call", "x", 2, 2)], "id bigint, file_id bigint, kind string, name string, resolved_node_id bigint, containing_node_id bigint"),
    )
    both = maintain.workspace_add(main, other, "/other/")
    base = 10**9
    assert set(column(both.nodes, "id")) == {2, 1001, base + 1, base + 2}
    assert column(both.files.where("root_id = 1"), "path") == ["/other/src/lib.py"]
    cross = both.edges.where("evidence = 'workspace_cross_root'").first()
    assert (cross["src_id"], cross["dst_id"], round(cross["confidence"], 2)) == (2, base + 2, 0.75)
    assert both.refs.where("id = 1 AND resolved_node_id IS NOT NULL").first()["resolved_node_id"] == base + 2
    assert tuple(maintain.workspace_list(both).first()) == (1, "/other", 1, 1, 2)
    again = maintain.workspace_add(both, other, "/other")
    assert again.nodes.count() == 4 and again.roots.count() == 1
    gone = maintain.workspace_remove(again, "/other")
    assert gone.files.count() == 1 and gone.edges.count() == 1 and gone.roots.count() == 0
    with pytest.raises(NotFound):
        maintain.workspace_remove(gone, "/other")
    assert column(maintain.overlap_warnings(both.roots, "/other/sub"), "warning") == ["contains the new root"]
