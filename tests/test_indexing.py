"""Scanning, extraction, resolution, incremental indexing, streams and scoring."""

import json
import os
import subprocess
import time

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.extract.udf import extract, extract_text, register
from loomgraph.graph import kv_get, load
from loomgraph.operators import maintain, resolve
from loomgraph.plans.indexing import dense_ids, index
from loomgraph.schema import InvalidInput
from loomgraph.scoring import answers
from loomgraph.sources import scan as source
from loomgraph.streaming import watch
from tests.graphs import build


def names(out, kind=None):
    return [s["name"] for s in out["symbols"] if kind is None or s["kind"] == kind]


def refs(out, kind):
    return [r for r in out["refs"] if r["kind"] == kind]


def run(language, text):
    return extract_text("f", language, text)


def test_python():
    out = run("python", "import os\nfrom a import b\nX = 1\n# says hi\ndef f(a, b=2) -> int:\n    return g(a, 'x')\nclass C(Base):\n    def m(self):\n        self.helper.run(1)\n")
    assert names(out, "function") == ["f", "m"] and names(out, "class") == ["C"] and names(out, "variable") == ["X"]
    f = out["symbols"][names(out).index("f")]
    assert f["doc"] == "says hi" and f["signature"] == "def f(a, b=2) -> int" and (f["start_line"], f["end_line"]) == (5, 6)
    assert [(r["name"], r["arg_count"], r["arg_pattern"]) for r in refs(out, "call")] == [("g", 2, "identifier,string"), ("self.helper.run", 1, "number")]
    assert [out["symbols"][r["containing"]]["name"] for r in refs(out, "call")] == ["f", "m"]
    assert [r["name"] for r in refs(out, "include")] == ["import os", "from a import b"]
    assert run("python", "def (")["parse_status"] == "failed" and run("sql", "select 1")["parse_status"] == "skipped"


def test_javascript_constructors():
    out = run("javascript", "function Core(options) {\n  this.options = options;\n  this.name = 'x';\n  function inner() { this.hidden = 1; }\n}\nfunction plain(a) { return a; }\nvar helper = function (b) { return b; };\n")
    assert names(out, "constructor_fn") == ["Core"] and set(names(out, "function")) >= {"plain", "inner"} and "helper" in names(out, "variable")
    fields = [s for s in out["symbols"] if s["kind"] == "field"]
    assert [(f["name"], f["start_line"], f["qualname"]) for f in fields] == [("options", 2, "Core._fields.options"), ("name", 3, "Core._fields.name")]
    assert sum(e["evidence"] == "constructor_field" for e in out["edges"]) == 2
    more = run("javascript", "Foo = function (a) { this.a = a; };\nmodule.exports = function ExportedThing(b) { this.b = b; };\nvar x = {};\nx.Collection = exports.Collection = function () { this.items = []; };\nBar = function () { return 1; };\n")
    assert set(names(more, "constructor_fn")) == {"Foo", "ExportedThing", "Collection"}
    uses = run("javascript", "class A {\n  run() {\n    this.count = this.total + 1;\n    this.go(2);\n  }\n}\n")
    assert {(r["name"], r["evidence"]) for r in refs(uses, "field_access")} == {("count", "this_member_write"), ("total", "this_member_read")}
    assert names(uses, "method") == ["run"] and [r["name"] for r in refs(uses, "call")] == ["this.go"]


def test_typescript_receivers():
    out = run("typescript", "import { LinkedMap } from './map';\nconst typed: LinkedMap = make();\ntyped.set('k', 1);\nconst made = new LinkedMap();\nmade.set('k', 2);\nclass U {\n  private readonly store: LinkedMap;\n  go(repo: SavedObjectsRepository) {\n    this.store.set('a', 3);\n    repo.find({ type: 'x' });\n  }\n}\nexport type ID = string;\ninterface Shape { area(): number; }\nenum Color { Red }\n")
    calls = {r["name"]: r for r in refs(out, "call")}
    assert calls["typed.set"]["arg_count"] == 2 and calls["typed.set"]["arg_pattern"] == "string,number"
    assert [calls[c]["receiver_type_hint"] for c in ("typed.set", "made.set", "this.store.set", "repo.find")] == ["LinkedMap"] * 3 + ["SavedObjectsRepository"]
    assert names(out, "type_alias") == ["ID"] and names(out, "interface") == ["Shape"] and names(out, "enum") == ["Color"] and "go" in names(out, "method")
    assert len(refs(out, "include")) == 1


def test_csharp():
    out = run("csharp", "using System;\nusing System.Linq;\nusing My.App;\nnamespace Zoo {\n  public interface IAnimal { void Speak(); }\n  public class Dog : Animal, IAnimal {\n    private int age;\n    public string Name { get; set; }\n    public event Handler Woke;\n    public void Speak() { Console.WriteLine(\"x\"); var d = new Dog(1); }\n  }\n  public delegate void Handler(int a);\n  struct P { }\n  enum E { A }\n}\n")
    assert [r["name"] for r in refs(out, "include")] == ["System", "System.Linq", "My.App"]
    assert [r["name"] for r in refs(out, "inherit")] == ["Animal", "IAnimal"]
    assert {r["name"] for r in refs(out, "call")} == {"Console.WriteLine", "Base"}
    for kind, name in (("namespace", "Zoo"), ("interface", "IAnimal"), ("class", "Base"), ("field", "age"), ("property", "Name"), ("event", "Woke"), ("delegate", "Handler"), ("struct", "P"), ("enum", "E")):
        assert name in names(out, kind), (kind, names(out, kind))
    assert names(out, "method").count("Speak") == 2


def test_cpp():
    out = run("cpp", '#include <vector>\n#include "base.h"\n#define MAX 10\nnamespace zoo {\n// A dog.\nclass Dog : public Animal {\n public:\n  void bark(int times);\n  int age_;\n};\nenum Color { RED };\ntypedef int Id;\n}\nvoid Dog::bark(int times) {\n  helper(times, "x");\n  tail.wag();\n}\nint main() { return 0; }\n')
    assert [r["name"] for r in refs(out, "include")] == ["<vector>", '"base.h"'] and [r["name"] for r in refs(out, "inherit")] == ["Animal"]
    assert names(out, "macro") == ["MAX"] and names(out, "namespace") == ["zoo"] and names(out, "class") == ["Base"] and names(out, "enum") == ["Color"] and "age_" in names(out, "field")
    assert {"bark", "Dog::bark", "main"} <= set(names(out, "function"))
    assert [(r["name"], r["arg_pattern"]) for r in refs(out, "call")] == [("helper", "identifier,string"), ("wag", "")]
    assert next(s for s in out["symbols"] if s["name"] == "Base")["doc"] == "A dog."


def test_other_languages():
    java = run("java", "import a.b.C;\npublic class Box {\n  private int size;\n  public Box(int s) { size = s; }\n  public int grow(int by) { return helper.add(by, 1); }\n}\n")
    assert names(java, "class") == ["Box"] and names(java, "function") == ["Box"] and names(java, "method") == ["grow"] and "size" in names(java, "field") and [r["name"] for r in refs(java, "call")] == ["add"]
    go = run("go", 'package main\nimport "fmt"\ntype Point struct { X int }\ntype Shape interface { Area() int }\nfunc (p Point) Move(d int) { fmt.Println(d) }\nfunc main() { run() }\n')
    assert names(go, "package") == ["main"] and names(go, "struct") == ["Point"] and names(go, "interface") == ["Shape"] and names(go, "method") == ["Move"] and names(go, "function") == ["main"]
    assert [r["name"] for r in refs(go, "call")] == ["fmt.Println", "run"]
    rust = run("rust", "use std::fmt;\npub struct P { x: i32 }\nenum E { A }\ntrait T { fn t(&self); }\nimpl P { pub fn new(x: i32) -> P { P::make(x) } }\nmod m {}\nconst N: i32 = 1;\nmacro_rules! mac { () => {} }\n")
    assert names(rust, "struct") == ["P"] and names(rust, "impl") == ["P"] and set(names(rust, "function")) == {"t", "new"} and names(rust, "macro") == ["mac"] and [r["name"] for r in refs(rust, "call")] == ["P::make"]
    bash = run("bash", "source lib.sh\nNAME=x\ndeploy() {\n  echo hi\n  kubectl apply -f x\n}\ndeploy\n")
    assert names(bash, "function") == ["deploy"] and names(bash, "variable") == ["NAME"] and [r["name"] for r in refs(bash, "call")] == ["kubectl", "deploy"]
    assert names(run("yaml", "a:\n  b: 1\n  - c: 2\n# d: 3\n")) == ["a", "b", "c"]


@pytest.mark.parametrize("language", ["cpp", "csharp", "javascript", "java", "go", "rust", "bash", "yaml", "python"])
@pytest.mark.parametrize("text", ["", "{{{{", "((((\n\"", "class", "function (", "\x00\n\ud7ff", "a" * 10000])
def test_broken_text_is_no_crash(language, text):
    assert run(language, text)["parse_status"] in ("ok", "failed")


def test_limits_and_tasks(spark):
    out = extract_text("f", "yaml", "\n".join(f"k{i}: 1" for i in range(10)), max_symbols=3)
    assert out["truncated"] and out["parse_status"] == "partial" and len(out["symbols"]) == 3
    df = spark.createDataFrame([("a.py", "python", "def f(): pass"), ("b.yaml", "yaml", "x: 1\n" * 100), ("c.py", "python", None)], "path string, language string, text string")
    rows = {r["path"]: r for r in extract(df, max_bytes=100).collect()}
    assert rows["a.py"]["symbols"][0]["name"] == "f" and rows["b.yaml"]["parse_status"] == "partial" and rows["c.py"]["symbols"] == []
    register(spark)
    assert spark.sql("SELECT camel_split('getHTTPName') AS x").first()["x"] == "getHTTPName get HTTP Name"
    assert spark.sql("SELECT name FROM extract_symbols('a', 'python', 'def f(): pass')").first()["name"] == "f"


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "src/lib.py").write_text("def helper(a):\n    return a\n\nclass Base:\n    pass\n")
    (root / "src/app.py").write_text("import lib\n\ndef run():\n    return helper(1)\n\ndef helper_user():\n    run()\n")
    (root / "build/gen.py").write_text("x = 1\n")
    (root / "notes.log").write_text("no\n")
    (root / "skip.py").write_text("y = 1\n")
    (root / ".gitignore").write_text("skip.py\n*.log\n")
    return root


def test_scan(spark, tree):
    paths = lambda **o: [r["relative_path"] for r in source.scan(spark, str(tree), **o).collect()]
    assert paths() == ["src/app.py", "src/lib.py"]
    assert paths(no_gitignore=True) == ["skip.py", "src/app.py", "src/lib.py"]
    assert paths(exclude=["app.*"]) == ["src/lib.py"] and paths(max_files=1) == ["src/app.py"]
    assert source.safe_path("src/lib.py", str(tree)) and not source.safe_path("../x", str(tree)) and not source.safe_path("/etc/passwd", str(tree)) and not source.safe_path("src", str(tree))
    os.symlink("/etc/hostname", tree / "src/out.py")
    assert paths() == ["src/app.py", "src/lib.py"]
    rows = source.read_contents(source.scan(spark, str(tree))).select("relative_path", source.content_hash("content").alias("h")).collect()
    assert {r["relative_path"]: r["h"] for r in rows}["src/lib.py"] == xxhash.xxh3_64_hexdigest((tree / "src/lib.py").read_bytes())


def test_git(spark, tree):
    run_git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    run_git("init", "-q")
    run_git("add", ".")
    run_git("commit", "-qm", "one")
    first = source.git_head(str(tree))
    (tree / "src/lib.py").write_text("def helper(a):\n    return a + 1\n")
    run_git("commit", "-qam", "two")
    assert [r["path"] for r in source.changed_files(spark, str(tree), first).collect()] == ["src/lib.py"]
    with pytest.raises(InvalidInput):
        source.changed_files(spark, str(tree), "nothing")
    assert [r["relative_path"] for r in source.scan(spark, str(tree)).collect()] == ["build/gen.py", "src/app.py", "src/lib.py"]


def test_index_and_reindex(spark, tree, tmp_path):
    g = index(spark, str(tree))
    calls = lambda g: {(r["s"], r["d"]) for r in g.edges.where("kind = 'calls'").join(g.nodes.select(F.col("id").alias("src_id"), F.col("name").alias("s")), "src_id").join(g.nodes.select(F.col("id").alias("dst_id"), F.col("name").alias("d")), "dst_id").collect()}
    assert calls(g) == {("run", "helper")}  # calls within a file make no edges
    assert maintain.doctor(g)[2] == 0 and kv_get(g.kv, "schema_version") == "8"
    ids = [r["id"] for r in g.nodes.collect()]
    assert len(set(ids)) == len(ids) == g.nodes.agg(F.max("id")).first()[0]
    store = f"file://{tmp_path}/store"
    assert watch.index_version(spark, str(tree), store) == 1
    (tree / "src/lib.py").write_text("def assist(a):\n    return a\n")
    (tree / "src/new.py").write_text("def helper():\n    pass\n")
    (tree / "src/app.py").write_text("def run():\n    assist(2)\n    helper()\n")
    assert watch.index_version(spark, str(tree), store) == 2
    two = load(spark, store)
    assert calls(two) == {("run", "assist"), ("run", "helper")} and maintain.doctor(two)[2] == 0
    os.remove(tree / "src/new.py")
    three = index(spark, str(tree), two)
    assert calls(three) == {("run", "assist")} and three.files.count() == 2 and maintain.doctor(three)[2] == 0
    assert load(spark, store, 1).files.count() == 2
    assert index(spark, str(tree), three, force=True).files.count() == 2


def test_detection_and_quarantine(spark):
    scanned = spark.createDataFrame([("a", 1, 1), ("b", 1, 9), ("c", 5, 5), ("d", 2, 2)], "relative_path string, size_bytes bigint, mtime_ns bigint")
    files = spark.createDataFrame([("a", 1, 1, "h", None), ("b", 1, 1, "h", None), ("c", 1, 1, "h", None), ("gone", 1, 1, "h", None), ("other", 1, 1, "h", 3)], "path string, size_bytes bigint, mtime_ns bigint, content_hash string, root_id bigint")
    hashes = spark.createDataFrame([("b", "h"), ("c", "k")], "path string, content_hash string")
    status = {r["path"]: r["status"] for r in maintain.detect(scanned, files, hashes).collect()}
    assert status == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "new", "gone": "deleted"}
    assert {r["path"]: r["status"] for r in maintain.detect(scanned, files, hashes, force=True).collect()}["a"] == "changed"
    crash = lambda p, at: spark.createDataFrame([(p, "boom " + at, at)], "path string, error string, at string")
    q = maintain.quarantine_add(maintain.quarantine_add(spark.createDataFrame([], "path string"), crash("a", "1")), crash("a", "2"))
    assert tuple(q.first()) == ("a", 2, "1", "2", "boom 2")
    assert maintain.without_quarantined(scanned, q).count() == 3
    assert maintain.quarantine_rehab(q, scanned, files).count() == 1 and maintain.quarantine_rehab(maintain.quarantine_add(q, crash("c", "1")), scanned, files).count() == 1


def test_resolution_rules(spark):
    files = [(1, "src/a.cpp", "cpp"), (2, "src/b.cpp", "cpp"), (3, "tests/test_b.cpp", "cpp"), (4, "src/base.h", "cpp")]
    symbols = [(10, "function", "go", "go", 1, 1, 2), (11, "function", "go", "go", 2, 1, 2), (12, "function", "go", "go", 3, 1, 2), (13, "class", "Base", "Base", 4, 1, 9), (14, "function", "only", "only", 1, 5, 6)]
    rows = [(1, "call", "go", 3, 0, 14), (1, "call", "x.go", 4, 0, 14), (1, "call", "only", 5, 0, 10), (1, "inherit", "Base", 6, 0, 14), (1, "include", '"base.h"', 1, 0, None), (3, "call", "go", 3, 0, 12)]
    g = build(spark, files, symbols, [], rows)
    out = resolve.resolve(g)
    got = {(r["src_id"], r["dst_id"], r["kind"]) for r in out.edges.collect()}
    assert got == {(14, 11, "calls"), (14, 13, "inherits"), (12, 10, "calls")}
    assert (1001, 1004, "includes") in {(r["src_id"], r["dst_id"], r["kind"]) for r in resolve.resolve(g, normalize_includes=True).edges.collect()}
    assert resolve.resolve(out).edges.count() == 3


def test_dense_ids(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    got = dense_ids(df, "k", 7)
    assert sorted(r["id"] for r in got.collect()) == list(range(8, 5008))
    assert got.orderBy("k").collect() == dense_ids(df.repartition(7), "k", 7).orderBy("k").collect()


def test_watching(spark, tree, tmp_path):
    events, seen = watch.poll(spark, str(tree), None)
    assert {r["type"] for r in events.collect()} == {"Created"}
    (tree / "src/more.py").write_text("z = 1\n")
    os.remove(tree / "src/lib.py")
    assert {(r["path"], r["type"]) for r in watch.poll(spark, str(tree), seen)[0].collect()} == {("src/more.py", "Created"), ("src/lib.py", "Deleted")}
    store, versions = f"file://{tmp_path}/store", []
    q = watch.watch(spark, str(tree), store, "1 second", versions.append)
    try:
        end = time.time() + 90
        while not versions and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert versions and load(spark, store).files.count() == 2
    hits = []
    r = watch.Reindexer(lambda: (time.sleep(0.2), hits.append(1)))
    assert [r.request(), r.request(), r.request()] == ["started", "queued", "queued"] and r.wait() and len(hits) == 2
    assert watch.freshen("eager", True, lambda: hits.append(2)) == "reindexed" and watch.freshen("lazy", True, lambda: 1 / 0) == "kept" and watch.freshen("normal", False, lambda: 1 / 0) == "kept"
    with pytest.raises(InvalidInput):
        watch.freshen("nothing", True, lambda: None)


def test_streaming_state_and_windows(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [("a", 1, True), ("b", 1, True), ("a", 2, True), ("b", 1, False)]
    pd.DataFrame(rows[:2], columns=["path", "mtime_ns", "exists"]).to_parquet(feed / "1.parquet")
    stream = spark.readStream.schema("path string, mtime_ns bigint, exists boolean").option("maxFilesPerTrigger", 1).parquet(str(feed))
    q = watch.known_files(stream).writeStream.format("memory").queryName("known").outputMode("append").start()
    q.processAllAvailable()
    pd.DataFrame(rows[2:], columns=["path", "mtime_ns", "exists"]).to_parquet(feed / "2.parquet")
    q.processAllAvailable()
    q.stop()
    assert sorted((r["path"], r["type"]) for r in spark.table("known").collect()) == [("a", "Created"), ("a", "Modified"), ("b", "Created"), ("b", "Deleted")]
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00.5"), ("a", "2024-01-01 00:00:05")], "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in watch.debounce(t, "ts", "path").collect()) == [1, 2]
    assert watch.windowed_counts(t, "ts", "4 seconds", "2 seconds").agg(F.sum("n")).first()[0] == 6


def test_scores(spark):
    text = "Thinking about x.py:1.\n<final_answer>\nsrc/a.py:3-5\nsrc/a.py:3-5\n/r/b.py:9\nc.py:1-2\n</final_answer>"
    cited = answers.citations(spark.createDataFrame([(1, text)], "id int, text string"))
    assert {tuple(r)[1:] for r in cited.collect()} == {("src/a.py", 3, 5), ("/r/b.py", 9, 9), ("c.py", 1, 2)}
    truth = spark.createDataFrame([(1, "src/a.py", 4, 7), (1, "lib/c.py", 1, 2)], "id int, file string, start_line int, end_line int")
    plain = answers.canonical_paths(cited, truth, "/r")
    assert {r["file"] for r in plain.collect()} == {"src/a.py", "b.py", "lib/c.py"}
    f = answers.file_scores(plain, truth).first()
    assert (f["hits"], f["found"], f["wanted"], round(f["precision"], 3), f["recall"]) == (2, 3, 2, 0.667, 1.0)
    s = answers.line_scores(plain, truth).first()
    assert (s["hits"], s["found"], s["wanted"]) == (4, 6, 6) and round(s["f1"], 4) == 0.6667
    assert {r["file"]: r["coverage"] for r in answers.range_coverage(plain, truth).collect()} == {"src/a.py": 0.5, "lib/c.py": 1.0}
    assert {(r["file"], r["side"]) for r in answers.missing_and_extra(plain, truth).collect()} == {("b.py", "extra")}
    reads = spark.createDataFrame([(1, 0, "a", 1, 10), (1, 1, "a", 5, 6), (1, 2, "b", 1, 2), (1, 3, "a", 20, 30)], "id int, n int, file string, start_line int, end_line int")
    assert answers.rereads(reads).first()["reread_rate"] == 0.25
    uses = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 6), (1, 3, None)], "id int, n int, node_id int")
    assert tuple(answers.node_reuse(uses).first()) == (1, 3, 1)
    calls = answers.normalize_calls(json.dumps({"steps": [{"name": "symbol_get", "input": "{\"a\": 1}", "output": "x"}, {"tool": "shell"}, 3]}))
    assert [(c["tool"], c["arguments"]) for c in calls] == [("symbol_get", {"a": 1}), ("shell", {})]
    assert answers.status({"n": 5, "t": 0.4}, {"min_n": 3, "max_t": 1.0}) == ("PASS", []) and answers.status({"n": 1}, {"min_n": 3})[0] == "FAIL" and answers.status({"n": 3}, {"n": 3}, {"n": 4})[0] == "WARN"
