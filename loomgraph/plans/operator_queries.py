"""Queries that run whole operators of the library over the projected tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.extract.udf import extract
from loomgraph.functions import scalars as S
from loomgraph.functions.globs import matches_glob, scope_glob
from loomgraph.graph import Graph, conform, empty_graph, make_graph, migrate, spread
from loomgraph.operators import calls, context, fields, listing, maintain, resolve, text, traverse
from loomgraph.plans import indexing
from loomgraph.plans.catalog import _SITES, DOC_FILE, ORDER, PART, PRELUDE, query, raw
from loomgraph.plans.projection import tables
from loomgraph.scoring import answers
from loomgraph.scratch import materialize
from loomgraph.sources.scan import first_files
from loomgraph.streaming import watch


def documents(g: Graph, sf_dir: str) -> DataFrame:
    """(path, text) of the documents that are the graph's files."""
    d = tables(g.spark, sf_dir)["documents"].select(F.col("doc_id").alias("id"), "text")
    return g.files.select("id", "path").join(d, "id").select("path", "text")


# ---- A: sources and sinks


@query("A10_merge_files", "SELECT id, path, CASE WHEN language = 'python' AND root_id IS NULL THEN 'python3' ELSE language END AS language FROM g_files")
def _merge(g: Graph) -> DataFrame:
    """Every Python file of the main root is indexed again: its rows leave, and the new ones take their place."""
    new = g.files.where("language = 'python' AND root_id IS NULL").withColumn("language", F.lit("python3"))
    none = empty_graph(g.spark)
    out = indexing.merge(g, {"files": new, "nodes": none.nodes, "refs": none.refs, "edges": none.edges}, none.lines)
    return out.files.select("id", "path", "language")


@query("A10_merge_nodes", "SELECT n.id FROM g_nodes n WHERE NOT EXISTS (SELECT 1 FROM g_files f WHERE f.language = 'python' AND f.root_id IS NULL AND (f.id = n.file_id OR (n.node_type = 'file' AND n.name = f.path)))")
def _merged_nodes(g: Graph) -> DataFrame:
    new = g.files.where("language = 'python' AND root_id IS NULL")
    none = empty_graph(g.spark)
    return indexing.merge(g, {"files": new, "nodes": none.nodes, "refs": none.refs, "edges": none.edges}, none.lines).nodes.select("id")


@query("A13_workspace_files", "SELECT id, path, root_id FROM g_files UNION ALL SELECT 4000000000 + id, '/x/' || path, CAST(4 AS BIGINT) FROM g_files WHERE root_id IS NULL")
def _added(g: Graph) -> DataFrame:
    return maintain.workspace_add(g, g, "/x/").files.select("id", "path", "root_id")


query(
    "A13_workspace_nodes",
    """SELECT id, name FROM g_nodes UNION ALL
SELECT 4000000000 + n.id, CASE WHEN node_type = 'file' THEN '/x/' || name ELSE name END FROM g_nodes n
WHERE EXISTS (SELECT 1 FROM g_files f WHERE f.root_id IS NULL AND (f.id = n.file_id OR (n.node_type = 'file' AND n.name = f.path)))""",
)(lambda g: maintain.workspace_add(g, g, "/x").nodes.select("id", "name"))

query("A22_first_files", "SELECT path AS relative_path FROM g_files ORDER BY path LIMIT 100")(lambda g: first_files(g.files.select(F.col("path").alias("relative_path")), 100))


@raw("A23_size_cap", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN strlen(text) > 10000 THEN 'partial' ELSE 'skipped' END AS parse_status FROM documents")
def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files above the cap are only recorded; the others have no extractor here, so they are skipped."""
    texts = tables(spark, sf_dir)["documents"].select(F.col("doc_id").cast("string").alias("path"), F.lit("prose").alias("language"), "text")
    return extract(texts, max_bytes=10_000).select("path", "parse_status")


# ---- B: resolution of paths and names


query("B16_scope", "SELECT path FROM g_files WHERE path GLOB 'src2/*' OR path GLOB 'src3/e?/doc_1*'")(
    lambda g: g.files.where(matches_glob(F.col("path"), scope_glob("src2/")) | matches_glob(F.col("path"), scope_glob("src3/e?/doc_1*"))).select("path")
)
query("B17_resolve_file", "SELECT min(path) AS path FROM g_files WHERE ends_with(lower(path), '/doc_3.' || split_part(path, '.', 2)) AND id = 3")(
    lambda g: g.spark.createDataFrame([(listing.resolve_file(g, g.files.where("id = 3").first()["path"].rsplit("/", 1)[1].upper()),)], "path string")
)
query("B18_resolve_directory", "SELECT 'file' AS type, path FROM g_files WHERE path GLOB 'src3/en/*' AND NOT path GLOB 'src3/en/*/*'")(lambda g: listing.dir_list_or_roots(g, "src3/en").select("type", "path"))
query("B20_resolve_node", "SELECT id FROM g_nodes WHERE name = 'widget' ORDER BY is_definition DESC, id LIMIT 1")(lambda g: g.spark.createDataFrame([(listing.resolve_node(g, symbol="widget"),)], "id bigint"))

# ---- C: scalars


@raw("C28_signature", "SELECT DISTINCT p_type, 'def ' || p_type || ' ( x )' AS signature FROM part")
def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir)["part"].select("p_type").distinct()
    return p.select("p_type", S.collapse_signature(F.concat(F.lit("  def\t"), "p_type", F.lit(" (\n  x )\n{ body }\n"))).alias("signature"))


@raw("C33_age", "SELECT o_orderkey, CAST(epoch(TIMESTAMP '2030-01-01 00:00:00') - epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS age FROM orders")
def _age(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir)["orders"]
    return o.select("o_orderkey", S.age_seconds(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.to_timestamp(F.lit("2030-01-01T00:00:00Z"))).alias("age"))


# ---- D: joins


query(
    "D4_include_join",
    """SELECT DISTINCT f.id AS file_id, n.id FROM g_files f JOIN g_nodes a ON a.node_type = 'file' AND a.name = f.path JOIN g_edges e ON e.src_id = a.id AND e.kind = 'includes'
JOIN g_nodes b ON e.dst_id = b.id JOIN g_files h ON h.path = b.name JOIN g_nodes n ON n.file_id = h.id AND n.kind = 'class'""",
)(lambda g: calls.included_files(g).join(g.nodes.where("kind = 'class'").select("id", F.col("file_id").alias("to_file")), "to_file").select(F.col("from_file").alias("file_id"), "id").distinct())
query("D11_enclosing", "SELECT id, end_line - start_line AS span FROM g_nodes WHERE file_id = 3 AND start_line <= 5 AND end_line >= 6 AND NOT (start_line = 5 AND end_line = 6)")(lambda g: calls.enclosing(g.nodes, 3, 5, 6).select("id", "span"))

_CLASS = "node_id % 25"
query(
    "D16_method_similarity",
    """, wf AS (SELECT containing_node_id AS node_id, name,
  CASE WHEN sum((evidence = 'this_member_write')::INT) > 0 AND sum((evidence <> 'this_member_write')::INT) > 0 THEN 1.5::DOUBLE WHEN sum((evidence = 'this_member_write')::INT) > 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS w
  FROM g_refs WHERE kind = 'field_access' GROUP BY 1, 2),
s AS (SELECT node_id, sum(w) AS total FROM wf GROUP BY 1),
p AS (SELECT x.node_id AS a, y.node_id AS b, sum(least(x.w, y.w)) AS low FROM wf x JOIN wf y ON x.name = y.name AND x.node_id % 25 = y.node_id % 25 AND x.node_id < y.node_id GROUP BY 1, 2)
SELECT a, b, round(low / (sa.total + sb.total - low), 6) AS similarity FROM p JOIN s sa ON sa.node_id = a JOIN s sb ON sb.node_id = b""",
)(lambda g: fields.similarity(g, g.refs.where("kind = 'field_access'").select(F.col("containing_node_id").alias("node_id")).distinct().withColumn("container", F.expr(_CLASS))).withColumn("similarity", F.round("similarity", 6)))

# ---- E, F: call sites


query(
    "E4_receiver_types",
    """, h AS (SELECT DISTINCT file_id, receiver_type_hint AS hint FROM g_refs WHERE receiver_type_hint IS NOT NULL),
inc AS (SELECT DISTINCT src_id - 8000000000 AS a, dst_id - 8000000000 AS b FROM g_edges WHERE kind = 'includes' AND src_id >= 8000000000)
SELECT h.file_id, hint, n.name AS resolved, CASE WHEN n.file_id = h.file_id THEN 'same_file' WHEN inc.a IS NOT NULL THEN 'included' WHEN n.id IS NOT NULL THEN 'global' END AS source, false AS ambiguous
FROM h LEFT JOIN g_nodes n ON n.name = h.hint AND n.kind = 'interface' LEFT JOIN inc ON inc.a = h.file_id AND inc.b = n.file_id""",
)(
    lambda g: calls.resolved_types(g, g.refs.where("receiver_type_hint IS NOT NULL").select("file_id", "receiver_type_hint").distinct()).select(
        "file_id", F.col("receiver_type_hint").alias("hint"), F.col("resolved_receiver_type").alias("resolved"), F.col("receiver_type_resolution_source").alias("source"), F.col("receiver_type_ambiguous").alias("ambiguous")
    )
)
query("F12_arity_bucket", f", {_SITES} SELECT coalesce(CAST(arg_count AS VARCHAR), 'unknown') AS value, count(*) AS n FROM scored GROUP BY 1")(lambda g: calls.candidate_buckets(calls.callsite_scores(g, PART))["arity"])
query("F12_file_bucket", f", {_SITES} SELECT path AS value, count(*) AS n FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")(lambda g: calls.candidate_buckets(calls.callsite_scores(g, PART))["file"])
query(
    "F12_arity_files",
    f""", {_SITES} SELECT arity, path, n, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY arity ORDER BY n DESC, path) AS nth
FROM (SELECT coalesce(CAST(arg_count AS VARCHAR), 'unknown') AS arity, path, count(*) AS n FROM scored GROUP BY 1, 2)) WHERE nth <= 3""",
)(lambda g: calls.candidate_buckets(calls.callsite_scores(g, PART))["arity_files"])
query("F9_impacted_files", f"SELECT DISTINCT n.file_path FROM g_edges e JOIN nf n ON n.id = e.src_id WHERE e.dst_id = {PART} AND e.kind = 'calls' AND e.confidence IS NOT NULL")(
    lambda g: traverse.impacted_files(traverse.impact_of(g, PART, depth=1, max_nodes=200))
)
query("F11_matches_per_file", "SELECT file_id, count(*) AS match_count FROM g_lines WHERE contains(lower(full_line), 'tion') GROUP BY 1")(lambda g: text.match_counts(text.code_hits(g, "tion")))

# ---- G: tools


query(
    "G4_dir_list",
    """SELECT DISTINCT 'dir' AS type, 'src3/' || split_part(path, '/', 2) || '/' AS path, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS BIGINT) AS size_bytes FROM g_files WHERE path GLOB 'src3/*'
UNION ALL SELECT 'file', path, language, size_bytes FROM g_files WHERE path GLOB 'src3/de/*' AND NOT path GLOB 'src3/de/*/*'""",
)(lambda g: listing.dir_list(g, "src3").unionByName(listing.dir_list(g, "src3/de")))
query(
    "G6_substring_search",
    """SELECT id AS node_id, kind, name, qualname, file_path, start_line, end_line FROM nf
WHERE contains(lower(name), 'idge') OR contains(lower(qualname), 'idge') ORDER BY length(name), name, file_path, start_line, id LIMIT 50""",
)(lambda g: listing.symbol_search(g, "idge"))


@raw(
    "G9_symbol_source",
    PRELUDE
    + f"""SELECT id AS node_id, name, file_path, array_to_string(list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), start_line, end_line), chr(10)) AS source
FROM nf JOIN documents ON doc_id = nf.file_id WHERE id IN ({PART}, {ORDER}, 3000000000, 5000000000)""",
)
def _with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.projection import project

    g = project(spark, sf_dir)
    return context.symbol_get(g, [PART, ORDER, 3_000_000_000, 5_000_000_000], documents(g, sf_dir)).select("node_id", "name", "file_path", "source")


def _levels(start: str, edges: str, depth: int) -> str:
    """CTEs l0..l<depth>: nodes by the level at which they are first reached, with the best edge there."""
    out = [f"l0 AS ({start})"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(d))
        out.append(f"l{d} AS (SELECT e.src_id AS id, max(e.confidence) AS confidence FROM ({edges}) e JOIN l{d - 1} ON e.dst_id = l{d - 1}.id WHERE e.src_id NOT IN ({seen}) GROUP BY 1)")
    return ", ".join(out)


query(
    "G19_impact_levels",
    ", " + _levels(f"SELECT CAST({DOC_FILE} AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS confidence", "SELECT * FROM g_edges WHERE kind <> 'contains'", 3)
    + " SELECT n.id AS node_id, n.name, n.file_path, 'includes' AS relationship, l.d AS distance FROM (SELECT id, 1 AS d FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) l JOIN nf n ON n.id = l.id",
)(lambda g: traverse.impact_of(g, DOC_FILE, depth=3))
query(
    "G19_impact",
    ", " + _levels(f"SELECT CAST({PART} AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS confidence", "SELECT * FROM g_edges WHERE kind <> 'contains'", 2)
    + " SELECT n.id AS node_id, n.name, n.file_path, 'calls' AS relationship, l.d AS distance FROM (SELECT id, 1 AS d FROM l1 UNION ALL SELECT id, 2 FROM l2) l JOIN nf n ON n.id = l.id ORDER BY l.d, l.id LIMIT 200",
)(lambda g: traverse.impact_of(g, PART, max_nodes=200))
_CONFIDENT = "SELECT e.* FROM g_edges e JOIN g_nodes c ON c.id = e.src_id AND c.node_type = 'symbol' WHERE e.kind = 'calls' AND e.confidence >= 0.5"
query(
    "G20_detect_changes",
    ", " + _levels("SELECT id, CAST(NULL AS DOUBLE) AS confidence FROM g_nodes WHERE kind IN ('function','method','class','interface') AND file_id IN (SELECT id FROM g_files WHERE parse_status = 'partial')", _CONFIDENT, 3)
    + """ SELECT n.id AS node_id, n.name, n.kind, n.file_path AS file, l.d AS distance, l.confidence FROM (SELECT *, 1 AS d FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) l JOIN nf n ON n.id = l.id
ORDER BY l.d, l.confidence DESC, file, name, node_id LIMIT 500""",
)(lambda g: traverse.detect_changes(g, g.files.where("parse_status = 'partial'").select("path"), depth=3))
_BASE = "Supplier_000000000"
query("G24_implementations", f"SELECT DISTINCT n.id AS node_id, n.name, n.qualname, n.kind, n.signature, n.file_path FROM g_nodes b JOIN g_edges e ON e.dst_id = b.id AND e.kind = 'inherits' JOIN nf n ON n.id = e.src_id WHERE b.name = '{_BASE}' ORDER BY node_id LIMIT 50")(
    lambda g: listing.find_implementations(g, _BASE)
)
query(
    "G28_code_search",
    """, h AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS match_count, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn, dense_rank() OVER (ORDER BY file_id) AS fr
  FROM g_lines WHERE contains(lower(full_line), 'worthless'))
SELECT f.path AS file, CAST(line_no AS INT) AS line, full_line AS text, match_count FROM h JOIN g_files f ON f.id = h.file_id WHERE rn <= 20 AND fr <= 50""",
)(lambda g: text.code_search(g, "Worthless"))
query(
    "G28_common_word",
    """, h AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS match_count, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn, dense_rank() OVER (ORDER BY file_id) AS fr
  FROM g_lines WHERE contains(lower(full_line), 'tion'))
SELECT f.path AS file, CAST(line_no AS INT) AS line, full_line AS text, match_count FROM h JOIN g_files f ON f.id = h.file_id WHERE rn <= 20 AND fr <= 500""",
)(lambda g: text.code_search(g, "tion", limit=500))

# ---- H, R: maintenance


query("H9_merge_duplicates", "SELECT file_path, name, kind, start_line, max(end_line) AS end_line FROM nf WHERE kind IN ('class','interface','function','method','namespace') GROUP BY 1, 2, 3, 4, qualname")(
    lambda g: listing.merge_duplicates(g.located()).select("file_path", "name", "kind", "start_line", "end_line")
)
_CRASHES = "SELECT path, 1 AS t FROM g_files UNION ALL SELECT path, 2 FROM g_files WHERE language = 'cpp'"


@query("R3_quarantine_upsert", f"SELECT path, CAST(count(*) AS INT) AS crash_count, '1' AS first_crash, CAST(max(t) AS VARCHAR) AS last_crash, 'e' || max(t) AS error FROM ({_CRASHES}) GROUP BY 1")
def _quarantined(g: Graph) -> DataFrame:
    """Every file crashes once, and those of one language again."""
    crash = lambda files, n: files.select("path", F.lit(f"e{n}").alias("error"), F.lit(str(n)).alias("at"))
    first = maintain.quarantine_add(g.quarantine, crash(g.files, 1))
    return maintain.quarantine_add(first, crash(g.files.where("language = 'cpp'"), 2)).select("path", "crash_count", "first_crash", "last_crash", "error")


query("R4_quarantine_rehab", "SELECT path FROM g_files WHERE language <> 'python'")(
    lambda g: maintain.quarantine_rehab(
        conform(g.files.select("path"), "quarantine"), g.files.select(F.col("path").alias("relative_path"), "size_bytes", F.expr("CASE WHEN language = 'python' THEN mtime_ns + 1 ELSE mtime_ns END").alias("mtime_ns")), g.files
    ).select("path")
)


@raw("R13_content_index", PRELUDE + "SELECT file_id, count(*) AS n FROM g_lines JOIN g_files f ON f.id = file_id WHERE f.parse_status <> 'partial' GROUP BY 1")
def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose status is partial are in the index already; the others' lines are added."""
    from loomgraph.plans.projection import project

    g = project(spark, sf_dir)
    tracked = g.files.where("parse_status = 'partial'").select(F.col("id").alias("file_id"))
    return text.index_lines(g, documents(g, sf_dir), tracked, most_bytes=0).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


query("R16_migration", "SELECT id, path, CAST(NULL AS BIGINT) AS root_id, CAST(NULL AS VARCHAR) AS parse_error FROM g_files")(
    lambda g: migrate({"files": g.files.select("path", "id"), "unknown": g.kv}, g.spark).files.select("id", "path", "root_id", "parse_error")
)


_R12 = """, d AS (SELECT DISTINCT file_id, name FROM g_refs WHERE kind = 'call'),
r AS (SELECT d.file_id, d.name, f.language AS lang, split_part(d.name, '.', 1) AS receiver, CASE WHEN length(split_part(d.name, '.', 2)) < 4 THEN d.name ELSE split_part(d.name, '.', 2) END AS bare FROM d LEFT JOIN g_files f ON f.id = d.file_id),
keys AS (SELECT DISTINCT name, lang, receiver, bare FROM r),
p AS (SELECT k.name, k.lang, n.id, n.is_definition = 1 AS is_def, coalesce(k.lang = n.language, false) AS same, contains(lower(n.qualname), lower(k.receiver)) AS agrees FROM keys k JOIN nf n ON n.kind = 'function' AND n.name = k.bare),
b AS (SELECT * FROM p WHERE same OR agrees QUALIFY row_number() OVER (PARTITION BY name, lang ORDER BY is_def DESC, same DESC, agrees DESC, id) = 1)
SELECT r.file_id, r.name, b.id AS target, round(least(1.0::DOUBLE, 0.4::DOUBLE + CASE WHEN is_def THEN 0.2 ELSE 0 END + CASE WHEN same THEN 0.15 ELSE 0 END + CASE WHEN agrees THEN 0.25 ELSE 0 END), 6) AS confidence
FROM r JOIN b ON b.name = r.name AND b.lang IS NOT DISTINCT FROM r.lang"""


@query("R12_cross_root", _R12)
def _cross(g: Graph) -> DataFrame:
    """Each distinct call of a file, unresolved and of root 2, against the functions of root 6."""
    by_file = materialize(g.refs.where("kind = 'call'").select("file_id", "name").distinct(), "by_file")
    numbered = indexing.dense_ids(by_file.withColumn("key", F.concat_ws("|", F.col("file_id").cast("string"), "name")), "key", 2 * 10**9, by_file.count()).drop("key")
    numbered = materialize(numbered, "numbered")  # both sides of the last join read it
    two = make_graph(g.spark, files=g.files, nodes=g.nodes.where("kind = 'function'"), refs=numbered.withColumn("kind", F.lit("call")))
    out = resolve.cross_root(two, 6).withColumnRenamed("ref_id", "id")
    return spread(numbered, "id").join(out, "id").select("file_id", "name", "target", F.round("confidence", 6).alias("confidence"))


# ---- K, Y


@raw(
    "K6_snapshot_diff",
    """SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS path, CASE WHEN a.m IS NULL THEN 'Created' WHEN b.m IS NULL THEN 'Deleted' ELSE 'Modified' END AS type
FROM (SELECT user_id, event_type, max(event_id) AS m FROM events WHERE event_type <> 'purchase' AND value < 50 GROUP BY ALL) a
FULL JOIN (SELECT user_id, event_type, max(event_id) AS m FROM events WHERE event_type <> 'click' GROUP BY ALL) b USING (user_id, event_type) WHERE a.m IS DISTINCT FROM b.m""",
)
def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of all users' files: one without purchases and dear events, one without clicks."""
    e = tables(spark, sf_dir)["events"]
    snap = lambda df: df.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path")).agg(F.max("event_id").alias("mtime_ns"))
    return watch.snapshot_events(snap(e.where("event_type <> 'purchase' AND value < 50")), snap(e.where("event_type <> 'click'")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir)["documents"]
    n = F.col("doc_id")
    text_ = F.concat(F.lit("see src/old.py:1 <final_answer>in ./lib/f"), (n % 7).cast("string"), F.lit(".py:"), (n % 20 + 4).cast("string"), F.lit("-"), (n % 20 + 1).cast("string"), F.lit(" and lib/f"), (n % 7).cast("string"), F.lit(".py:9 twice lib/f"), (n % 7).cast("string"), F.lit(".py:9</final_answer>"))
    return d.select(n.alias("id"), text_.alias("text"))


raw(
    "Y1_citations",
    """SELECT doc_id AS id, './lib/f' || (doc_id % 7) || '.py' AS file, CAST(doc_id % 20 + 1 AS INT) AS start_line, CAST(doc_id % 20 + 4 AS INT) AS end_line FROM documents
UNION ALL SELECT doc_id, 'lib/f' || (doc_id % 7) || '.py', 9, 9 FROM documents""",
)(lambda spark, sf_dir: answers.citations(_answers(spark, sf_dir)))
raw(
    "Y2_canonical_paths",
    """SELECT doc_id AS id, CASE WHEN doc_id % 7 = 3 THEN 'lib/f3.py' ELSE 'pkg/lib/f' || (doc_id % 7) || '.py' END AS file, CAST(doc_id % 20 + 1 AS INT) AS start_line, CAST(doc_id % 20 + 4 AS INT) AS end_line FROM documents
UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'lib/f3.py' ELSE 'pkg/lib/f' || (doc_id % 7) || '.py' END, 9, 9 FROM documents""",
)(
    lambda spark, sf_dir: answers.canonical_paths(
        answers.citations(_answers(spark, sf_dir)),
        tables(spark, sf_dir)["documents"].select(F.col("doc_id").alias("id"), F.explode(F.when(F.col("doc_id") % 7 == 3, F.array(F.lit("a/lib/f3.py"), F.lit("b/lib/f3.py"))).otherwise(F.array(F.concat(F.lit("pkg/lib/f"), (F.col("doc_id") % 7).cast("string"), F.lit(".py"))))).alias("file")),
    )
)
_TURNS = "SELECT conv_id AS id, role AS tool, turn AS n, turn % 3 AS node_id FROM conversations"
raw("Y5_tool_counts", f"SELECT id, tool, count(*) AS n FROM ({_TURNS}) GROUP BY 1, 2")(lambda spark, sf_dir: answers.tool_counts(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("role").alias("tool"))))
raw("Y5_node_reuse", f"SELECT id, count(*) AS uses, count(*) - count(DISTINCT node_id) AS reused FROM ({_TURNS}) GROUP BY 1")(
    lambda spark, sf_dir: answers.node_reuse(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("n"), (F.col("turn") % 3).alias("node_id")))
)
