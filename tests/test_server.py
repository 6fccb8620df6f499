"""Trees of any bytes, the quarantine, and the tools over a stored graph."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.adapters import tools
from loomgraph.extract.udf import extract_text
from loomgraph.graph import load
from loomgraph.plans.indexing import index
from loomgraph.schema import InvalidInput, NotFound
from loomgraph.sources import disk
from loomgraph.sources import scan as source
from loomgraph.streaming import watch


def test_trees_of_any_bytes(spark, tmp_path):
    (tmp_path / "a.py").write_text("def first():\n    pass\n")
    (tmp_path / "latin.c").write_bytes("int grösse(void) { return 1; }\nint plain(void) { return 2; }\n".encode("latin-1"))
    (tmp_path / "wide.py").write_bytes("def second():\n    pass\n".encode("utf-16"))
    (tmp_path / "raw.c").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "empty.py").write_bytes(b"")
    g = index(spark, str(tmp_path))
    status = {r["path"]: (r["parse_status"], r["parse_error"]) for r in g.files.collect()}
    assert status == {"a.py": ("ok", None), "latin.c": ("partial", "not UTF-8"), "wide.py": ("ok", None), "raw.c": ("partial", "binary"), "empty.py": ("ok", None)}
    assert {"first", "second", "plain"} <= {r["name"] for r in g.nodes.where("node_type = 'symbol'").collect()}
    again = index(spark, str(tmp_path), g)
    assert again.nodes.count() == g.nodes.count() and again.files.count() == 5


def test_texts_of_bytes():
    assert source.text_of("ü�".encode()) == ("ü�", None) and source.text_of(b"\xff") == ("�", "not UTF-8")
    assert source.text_of("ü".encode("utf-16-be", "replace"))[1] is not None and source.text_of("﻿ü".encode("utf-16-be")) == ("ü", None)
    assert source.text_of(b"\xef\xbb\xbfx") == ("x", None) and source.text_of(b"a\0b") == ("a b", "binary") and source.text_of(b"") == ("", None)


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "dir.py").mkdir()
    (tmp_path / "ok.py").write_text("x = 1\n")
    row = lambda p: (str(tmp_path / p), p, "python", 1, 1)
    rows = {r["relative_path"]: r for r in source.read_contents(spark.createDataFrame([row("dir.py"), row("ok.py"), row("gone.py")], source.SCANNED)).collect()}
    assert set(rows) == {"dir.py", "ok.py"} and rows["dir.py"]["read_error"].startswith("unreadable") and rows["dir.py"]["content"] is None
    lost = spark.createDataFrame([("/no/such/place/a.py", "a.py", "python", 1, 1)], source.SCANNED)
    with pytest.raises(Exception, match="all executors share"):  # a tree that is not mounted is no empty tree
        source.read_contents(lost).collect()


def test_slow_files_go_to_the_quarantine(spark, tmp_path):
    assert extract_text("a", "python", "x = [" + "1," * 300_000 + "]", slot_ms=1)["parse_error"].startswith("Timeout")
    (tmp_path / "slow.py").write_text("x = [" + "1," * 300_000 + "]\n")
    (tmp_path / "fast.py").write_text("def f():\n    pass\n")
    g = index(spark, str(tmp_path), slot_ms=1)
    assert [(r["path"], r["crash_count"]) for r in g.quarantine.where("path = 'slow.py'").collect()] == [("slow.py", 1)]
    assert g.files.where("path = 'slow.py'").first()["parse_status"] == "failed"
    same = index(spark, str(tmp_path), g)
    assert same.quarantine.where("path = 'slow.py'").count() == 1 and same.files.count() == 2
    (tmp_path / "slow.py").write_text("def now_fast():\n    pass\n")
    better = index(spark, str(tmp_path), same)
    assert better.quarantine.where("path = 'slow.py'").count() == 0 and better.nodes.where("name = 'now_fast'").count() == 1


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    """A repository of two revisions, indexed into a store, with a server; and another tree."""
    root, other = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("other")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    (root / "pkg").mkdir()
    (root / "pkg/ledger.py").write_text("class Ledger:\n    def total(self):\n        self.rows\n        return self.rows\n\n    def add(self, row):\n        self.rows = row\n\n\ndef open_ledger():\n    return 1\n")
    (root / "pkg/report.py").write_text("from ledger import open_ledger\n\n\ndef print_report():\n    return open_ledger()\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (root / "pkg/ledger.py").write_text((root / "pkg/ledger.py").read_text() + "\n\ndef close_ledger():\n    return 2\n")
    git("commit", "-qam", "two")
    (other / "tool.py").write_text("def print_report_twice():\n    print_report()\n")
    store = f"file://{tmp_path_factory.mktemp('store')}/s"
    watch.index_version(spark, str(root), store)
    return tools.Server(spark, store, str(root)), root, other


def ask(server, name, /, **arguments):
    """The tool's answer, by JSON."""
    out = io.StringIO()
    tools.serve(server, io.StringIO(json.dumps({"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": name, "arguments": arguments}}) + "\n"), out)
    answer = json.loads(out.getvalue())
    return json.loads(answer["result"]["content"][0]["text"]) if "result" in answer else answer["error"]


def test_every_tool_answers(served):
    server, root, _ = served
    ids = {r["name"]: r["id"] for r in server.graph.nodes.where("node_type = 'symbol'").collect()}
    asked = {
        "server_info": {}, "repo_stats": {}, "file_search": {"pattern": "*.py"}, "dir_list": {"path": "."}, "dir_tree": {"depth": 2}, "symbol_search": {"query": "ledger"}, "symbol_list": {"kind": "function"}, "symbols_in_path": {"path": "pkg", "kind": ["function", "class"]},
        "symbol_get": {"symbol": "open_ledger"}, "symbol_get_batch": {"node_ids": [ids["Ledger"], ids["total"]], "include_source": True}, "callers_approx": {"symbol": "open_ledger"}, "callees_approx": {"symbol": "print_report"}, "references": {"symbol": "open_ledger"}, "file_summary": {"path": "ledger.py"},
        "file_overview": {"path": "pkg/ledger.py"}, "context_for": {"symbol": "open_ledger", "include_source": True}, "context_by_name": {"name": "print_report"}, "entrypoints": {}, "impact_of": {"symbol": "open_ledger"}, "detect_changes": {"repo_root": str(root), "since": "HEAD~1"}, "file_deps": {"path": "pkg/report.py"},
        "subgraph": {"seed_symbols": [ids["print_report"]]}, "shortest_path": {"src_node_id": ids["print_report"], "dst_node_id": ids["open_ledger"]}, "find_implementations": {"symbol": "Ledger"}, "method_fields": {"node_id": ids["total"]}, "dependency_cluster": {"path": "pkg/ledger.py"},
        "source_at": {"path": "pkg/report.py", "start_line": 4, "end_line": 9}, "code_search": {"query": "open_ledger"}, "workspace_list": {}, "doctor": {},
    }
    got = {name: ask(server, name, **arguments) for name, arguments in asked.items()}
    assert not {n: a for n, a in got.items() if "code" in a} and set(asked) == set(tools.TOOLS) - {"reindex", "workspace_add", "workspace_remove"}
    assert got["symbol_get"]["symbol"][0]["source"] == "def open_ledger():\n    return 1\n" and got["symbol_get"]["symbol"][0]["stale"] is False
    assert [s["source"].split("\n")[0] for s in got["symbol_get_batch"]["results"]] == ["class Ledger:", "    def total(self):"]
    assert got["source_at"] == {"source": {"path": "pkg/report.py", "start_line": 4, "end_line": 5, "source": "def print_report():\n    return open_ledger()\n", "stale": False}}
    changed = got["detect_changes"]
    assert [r["path"] for r in changed["changed_files"]] == ["pkg/ledger.py"] and {r["name"] for r in changed["impacted_symbols"]} == {"print_report"}
    assert got["callers_approx"]["results"][0]["caller_name"] == "print_report" and got["context_for"]["symbol"][0]["source"].startswith("def open_ledger")
    assert [s["name"] for s in got["shortest_path"]["path"]] == ["print_report", "open_ledger"]


def test_schemas_and_bad_parameters(served):
    server = served[0]
    assert all(s["type"] == "object" and set(s["required"]) <= set(s["properties"]) for s in tools.SCHEMAS.values()) and set(tools.SCHEMAS) == set(tools.TOOLS)
    assert tools.SCHEMAS["code_search"]["required"] == ["query"] and "context_lines" in tools.SCHEMAS["code_search"]["properties"]
    for name, bad in (("source_at", {"path": "x"}), ("symbol_search", {"query": "a", "nonsense": 1}), ("symbol_search", {"query": 5}), ("impact_of", {"node_id": "7"}), ("source_at", {"path": "pkg/report.py", "start_line": 0, "end_line": 1}), ("source_at", {"path": "pkg/report.py", "start_line": 1, "end_line": 900}), ("detect_changes", {}), ("nothing", {})):
        assert ask(server, name, **bad)["data"]["error_code"] == "invalid_input", (name, bad)
    assert ask(server, "source_at", path="pkg/report.py", start_line=400, end_line=401)["data"]["error_code"] == "not_found"
    assert ask(server, "source_at", path="../secret.py", start_line=1, end_line=2)["data"]["error_code"] == "not_found"
    assert ask(server, "subgraph", seed_symbols=["x"])["data"]["error_code"] in ("internal", "invalid_input")  # and the server goes on
    with pytest.raises(InvalidInput):
        tools.call(server.graph, "reindex")


def test_reindex_and_workspaces(served, spark):
    server, root, other = served
    (root / "pkg/report.py").write_text("from ledger import open_ledger\n\n\n# moved\ndef print_report():\n    return open_ledger()\n")
    stale = ask(server, "symbol_get", symbol="print_report")["symbol"][0]
    assert stale["stale"] is True
    before = server.graph and server.version
    assert ask(server, "reindex", wait=True) == {"status": "done", "version": before + 1}
    fresh = ask(server, "symbol_get", symbol="print_report")["symbol"][0]
    assert (fresh["stale"], fresh["start_line"]) == (False, 5)
    added = ask(server, "workspace_add", path=str(other))
    assert [r["path"] for r in added["roots"]] == [str(other)] and added["roots"][0]["file_count"] == 1
    callers = ask(server, "callers_approx", symbol="print_report")["results"]
    assert [c["caller_name"] for c in callers] == ["print_report_twice"]
    assert ask(server, "source_at", path=f"{other}/tool.py", start_line=1, end_line=1)["source"]["source"] == "def print_report_twice():\n"
    assert ask(server, "workspace_remove", path=str(other))["roots"] == [] and load(spark, server.store).files.count() == 2
    assert ask(server, "workspace_remove", path=str(other))["data"]["error_code"] == "not_found"
    assert ask(server, "reindex")["status"] == "started" and server.reindexer.wait(120)


def test_policies_before_a_query(served, spark):
    server, root, _ = served
    eager = tools.Server(spark, server.store, str(root), "eager")
    old = eager.graph and eager.version
    subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", "commit", "-qam", "three"], check=True, capture_output=True)
    assert eager.call("repo_stats")["counts"][0]["file_count"] == 2 and eager.graph and eager.version == old + 1
    assert eager.call("repo_stats") and eager.version == old + 1  # no longer stale
    with pytest.raises(NotFound):
        disk.file_now(eager.graph, "nowhere.py")
    assert eager.graph.files.where(F.col("path") == "pkg/report.py").count() == 1


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.py").write_text("def one():\n    pass\n")
    store = f"file://{tmp_path}/store"
    run = lambda *a: (tools.main(list(a)), json.loads(capsys.readouterr().out))
    assert run("index", str(tmp_path / "t"), store) == (0, {"version": 1})
    assert run("query", store, "symbol_search", '{"query": "one"}')[1]["results"][0]["name"] == "one"
    assert run("doctor", store)[0] == 0
    code, found = run("parse-file", str(tmp_path / "t/a.py"))
    assert code == 0 and found["symbols"][0]["name"] == "one" and found["language"] == "python"
    assert run("parse-file", str(tmp_path / "t/none.py"))[0] == 1 and tools.main(["query"]) == 1
