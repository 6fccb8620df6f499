"""Every operator as a query over the projected tables, with DuckDB SQL as its oracle.

A query's name begins with the operator's number in the survey. Queries
without SQL (hashes, clusters, extraction) are tested on fixtures instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.functions.globs import in_directory, matches_any, matches_glob, matches_path
from loomgraph.graph import Graph, conform, spread
from loomgraph.operators import calls, context, fields, listing, maintain, paging, resolve, text, traverse
from loomgraph.plans.projection import PRELUDE, project
from loomgraph.scratch import materialize
from loomgraph.scoring import answers
from loomgraph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PART, ORDER, CUSTOMER, NATION, SUPPLIER, DOC_FILE = 6_000_000_005, 4_000_000_007, 3_000_000_012, 2_000_000_003, 5_000_000_001, 8_000_000_003


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query over the projected graph; the oracle may use the g_ tables of the prelude."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(project(spark, sf_dir))
        if sql:
            ORACLES[name] = PRELUDE + sql
        return f

    return add


def raw(name: str, sql: str | None = None) -> Callable:
    """Register a query over the stored tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs_of(g: Graph, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of the documents that are the graph's files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return g.files.select("id", "path").join(d, "id").select("path", "text")


# ---- G11 first: it is the flagship
query("G11_callers_exact", f"""SELECT n.id AS caller_node_id, n.name AS caller_name, n.file_path, e.confidence FROM g_edges e JOIN nf n ON e.src_id = n.id
WHERE e.dst_id = {PART} AND e.kind = 'calls' ORDER BY e.confidence DESC, n.id LIMIT 50""")(lambda g: calls.callers_page(g, PART))

# ---- A: sources
query("A5_language", "SELECT path, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'cpp' THEN 'cpp' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE '' END AS detected FROM g_files")(lambda g: g.files.select("path", S.language_of(F.col("path")).alias("detected")))


@raw("A7_content_hash")
def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.sources.scan import content_hash

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


@raw("A8_line_range", "SELECT doc_id, array_to_string(list_transform(list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 2, 4), lambda x: x || chr(10)), '') AS source FROM documents")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    return text.source_range(d, 2, 4).withColumnRenamed("path", "doc_id")


@raw("A9_source_truncation", "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) || chr(10) || '...(truncated)' ELSE text END AS source FROM documents")
def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.truncated(F.col("text"), 3).alias("source"))


@query("A11_kv_upsert", "SELECT * FROM (VALUES ('schema_version', '8'), ('last_index_time', '2024-01-01T00:00:00Z'), ('git_head', 'def'), ('git_branch', 'main'), ('repo_root', '/r')) t(key, value)")
def _kv(g: Graph) -> DataFrame:
    from loomgraph.graph import kv_put

    return kv_put(g.kv, {"git_head": "def", "repo_root": "/r"})


query("A14_json_rows", "SELECT id, '{\"id\":' || id || ',\"path\":\"' || path || '\"}' AS json FROM g_files")(lambda g: g.files.select("id", F.to_json(F.struct("id", "path")).alias("json")))
query("A21_counts", "SELECT (SELECT count(*) FROM g_files) AS files, (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges")(lambda g: g.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(g.nodes.agg(F.count(F.lit(1)).alias("nodes"))).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges"))))

# ---- B: filters and projections
query("B1_fields", "SELECT id AS node_id, name, file_path AS file, start_line FROM nf WHERE kind = 'function'")(lambda g: paging.select_fields(g.located().where("kind = 'function'"), ["node_id", "name", "file", "start_line"]))
query("B2_compact_shape", "SELECT id AS node_id, kind, name, nullif(qualname, name) AS qualname, signature, file_path AS file, start_line, end_line FROM nf WHERE kind IN ('function', 'class')")(lambda g: paging.shape(g.located().where("kind IN ('function', 'class')"), compact=True, handles=True))
query("B3_equality", "SELECT id, path FROM g_files WHERE language = 'python' AND parse_status = 'ok'")(lambda g: g.files.where((F.col("language") == "python") & (F.col("parse_status") == "ok")).select("id", "path"))
query("B4_in_list", "SELECT id, name FROM g_nodes WHERE kind IN ('interface', 'namespace')")(lambda g: g.nodes.where(F.col("kind").isin("interface", "namespace")).select("id", "name"))
query("B5_glob", "SELECT id, path FROM g_files WHERE path GLOB 'src1*/en/doc_?[0-4]*.py'")(lambda g: g.files.where(matches_glob(F.col("path"), "src1*/en/doc_?[0-4]*.py")).select("id", "path"))
query("B6_direct_children", "SELECT id, path FROM g_files WHERE path GLOB 'src3/en/*' AND NOT path GLOB 'src3/en/*/*'")(lambda g: g.files.where(in_directory(F.col("path"), "src3/en")).select("id", "path"))
query("B7_suffix_contains", "SELECT id, qualname FROM g_nodes WHERE ends_with(lower(qualname), '.widget') OR contains(lower(qualname), 'cold')")(lambda g: g.nodes.where(F.lower("qualname").endswith(".widget") | F.lower("qualname").contains("cold")).select("id", "qualname"))
_PUBLIC = "coalesce(visibility = 'public', false) OR (visibility IS NULL AND (qualname IS NULL OR qualname = '' OR qualname = name) AND kind IN ('class','interface','struct','enum','type_alias','trait','function'))"
query("B8_public", f"SELECT id, name FROM g_nodes WHERE {_PUBLIC}")(lambda g: g.nodes.where(S.is_public(F.col("visibility"), F.col("qualname"), F.col("name"), F.col("kind"))).select("id", "name"))
query("B9_span", "SELECT id FROM g_nodes WHERE end_line - start_line + 1 >= 10")(lambda g: g.nodes.where(S.spans_at_least(F.col("start_line"), F.col("end_line"), 10)).select("id"))
query("B10_kind_widening", "SELECT id FROM g_nodes WHERE kind IN ('function', 'method')")(lambda g: g.nodes.where(F.col("kind").isin(*listing.CALLABLE)).select("id"))
query("B11_confidence", "SELECT src_id, dst_id FROM g_edges WHERE kind = 'calls' AND confidence >= 0.795")(lambda g: g.edges.where("kind = 'calls' AND confidence >= 0.795").select("src_id", "dst_id"))
query("B12_receiver", "SELECT DISTINCT name FROM g_refs WHERE kind = 'call' AND (lower(split_part(name, '.', 1)) = 'small')")(lambda g: materialize(g.refs.where("kind = 'call'").select("name").distinct(), "names").where(S.receiver_passes(S.receiver_of(F.col("name"), S.last_part(F.col("name"))), F.lit(""), "small")))  # written, else the optimizer judges every reference's name before it is made distinct
query("B14_exclude", "SELECT path FROM g_files WHERE NOT (regexp_matches(path, '^src1/.*$') OR regexp_matches(path, '^[^/]*/fr/[^/]*\\.ts$') OR regexp_matches(split_part(path, '/', 3), '^[^/]*\\.go$'))")(lambda g: g.files.where(~matches_any(F.col("path"), ["src1/**", "*/fr/*.ts", "*.go"])).select("path"))
query("B15_changed_pattern", "SELECT path FROM g_files WHERE regexp_matches(split_part(path, '/', 3), '^doc_[^/]\\.[^/]*$')")(lambda g: g.files.where(matches_path(F.col("path"), "doc_?.*")).select("path"))
query("B22_eligible_lines", "SELECT file_id, CAST(line_no AS INT) AS line_no FROM g_lines")(lambda g: g.lines.select("file_id", "line_no"))


# ---- C: scalars
@raw("C1_camel_split", """SELECT DISTINCT x, CASE WHEN y = x THEN x ELSE x || ' ' || y END AS split FROM (SELECT x, regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS y FROM (SELECT lower(p_type) || 'HTTP' || upper(p_brand[1]) || p_brand[2:] || 'Name' AS x FROM part))""")
def _camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("concat(lower(p_type), 'HTTP', upper(substring(p_brand, 1, 1)), substring(p_brand, 2), 'Name')")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(x.alias("x")).distinct().select("x", S.camel_split(F.col("x")).alias("split"))


query("C4_name_parts", """SELECT DISTINCT qualname, regexp_extract(qualname, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1) AS trailing, CASE WHEN contains(qualname, '.') THEN regexp_replace(qualname, '\\.[^.]*$', '') ELSE '' END AS owner,
CASE WHEN contains(qualname, '.') THEN split_part(qualname, '.', 2) END AS last, CASE WHEN contains(qualname, '.') THEN split_part(qualname, '.', 1) END AS receiver, lower(name) IN ('get','set','add','delete','remove','has','push','pop','call','apply','map','filter','find','update','create','run') AS common
FROM g_nodes WHERE kind = 'function'""")(lambda g: materialize(g.nodes.where("kind = 'function'").select("qualname", "name").distinct(), "names").select("qualname", S.trailing_identifier(F.col("qualname")).alias("trailing"), S.owner_of(F.col("qualname")).alias("owner"), S.last_part(F.col("qualname")).alias("last"), S.receiver_of(F.col("qualname"), F.col("name")).alias("receiver"), S.is_common_member(F.col("name")).alias("common")).distinct())


@raw("C3_separator_suffix", "SELECT DISTINCT p_name, ends_with(replace(p_name, ' ', '.'), '.ring') AS suffix, lower(p_name) = 'cold widget' AS same FROM part")
def _suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", S.ends_in_part(F.regexp_replace("p_name", " ", "."), F.lit("RING")).alias("suffix"), S.same_name(F.col("p_name"), F.lit("COLD Widget")).alias("same")).distinct()


@raw("C8_type_hints", "SELECT DISTINCT p_type, p_type AS plain, p_type || '?x' AS kept FROM part")
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct()
    return p.select("p_type", S.plain_type(F.concat(F.lit("readonly "), "p_type", F.lit("<Map<K>>[] | undefined"))).alias("plain"), S.clean_receiver(F.concat(F.lit("  "), "p_type", F.lit("?x ?"))).alias("kept"))


query("C16_pattern_bonus", """SELECT DISTINCT arg_pattern, CASE arg_pattern WHEN 'number,string,bool' THEN CAST(0.04 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS bonus FROM g_refs WHERE kind = 'call'""")(lambda g: g.refs.where("kind = 'call'").select("arg_pattern").distinct().select("arg_pattern", F.round(S.pattern_bonus(F.col("arg_pattern"), F.lit("number,string,bool")), 6).alias("bonus")))
query("C17_receiver_strength", "SELECT DISTINCT name, CASE WHEN split_part(name, '.', 1) = 'small' THEN 3 ELSE 0 END AS strength FROM g_refs WHERE kind = 'call'")(lambda g: g.refs.where("kind = 'call'").select("name").distinct().select("name", S.receiver_strength(F.split_part("name", F.lit("."), F.lit(1)), F.lit("small"), F.lit("small")).alias("strength")))
query("C19_listing_cost", "SELECT id, CAST(64 + octet_length(CAST(kind AS BLOB)) + octet_length(CAST(name AS BLOB)) + coalesce(octet_length(CAST(signature AS BLOB)), 0) AS BIGINT) AS cost FROM g_nodes WHERE node_type = 'symbol'")(lambda g: g.nodes.where("node_type = 'symbol'").select("id", S.listing_cost(F.col("kind"), F.col("name"), F.col("signature")).alias("cost")))
query("C20_test_path", "SELECT path, regexp_matches(lower(path), '/test|/mock|/fake|/stub|_test\\.|_mock\\.|_fake\\.|test_') AS is_test FROM g_files")(lambda g: g.files.select("path", S.is_test_path(F.col("path")).alias("is_test")))
query("C22_bare_name", "SELECT DISTINCT name, CASE WHEN contains(name, '.') THEN CASE WHEN length(split_part(name, '.', 2)) < 4 THEN name ELSE split_part(name, '.', 2) END ELSE name END AS bare FROM g_refs")(lambda g: g.refs.select("name").distinct().select("name", S.bare_name(F.col("name")).alias("bare")))
query("C23_cross_confidence", "SELECT id, least(1.0::DOUBLE, 0.4::DOUBLE + CASE WHEN is_definition = 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN id % 3 = 0 THEN 0.25::DOUBLE ELSE 0 END) AS confidence FROM g_nodes")(lambda g: g.nodes.select("id", S.cross_root_confidence(F.col("is_definition") == 1, F.col("id") % 2 == 0, F.col("id") % 3 == 0).alias("confidence")))
query("C29_first_doc_line", "SELECT id, trim(split_part(doc, chr(10), 1)) AS first_line FROM g_nodes WHERE kind = 'function'")(lambda g: g.nodes.where("kind = 'function'").select("id", S.first_line(F.col("doc")).alias("first_line")))
query("C30_path_parts", "SELECT path, split_part(path, '/', 3) AS base, regexp_replace(path, '/[^/]*$', '') AS module FROM g_files")(lambda g: g.files.select("path", S.base_name(F.col("path")).alias("base"), S.module_of(F.col("path")).alias("module")))
query("C31_slot_timeout", "SELECT id, CAST(least(5000 + 10 * (size_bytes // 1024), 10000) AS BIGINT) AS ms FROM g_files")(lambda g: g.files.select("id", S.slot_timeout_ms(F.col("size_bytes"), 5000).alias("ms")))
query("C34_tokens", "SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(stable_key), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM g_nodes")(lambda g: g.nodes.select("id", F.array_join(S.fold_tokens(F.col("stable_key")), " ").alias("tokens")))
query("C35_trigrams", "SELECT id, array_to_string(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3)), '|') AS grams FROM g_nodes")(lambda g: g.nodes.select("id", F.array_join(S.trigrams(F.col("name")), "|").alias("grams")))

# ---- D: joins
query("D1_nodes_files", "SELECT id, file_path, language FROM nf")(lambda g: g.located().select("id", "file_path", "language"))
query("D2_edges_nodes", "SELECT e.src_id, e.dst_id, n.name, n.file_path FROM g_edges e JOIN nf n ON e.dst_id = n.id WHERE e.kind = 'inherits'")(lambda g: g.edges.where("kind = 'inherits'").drop("id").join(g.located(), F.col("dst_id") == F.col("id")).select("src_id", "dst_id", "name", "file_path"))
query("D3_refs_files_nodes", "SELECT r.name, f.path, n.name AS holder, count(*) AS n FROM g_refs r LEFT JOIN g_files f ON r.file_id = f.id LEFT JOIN g_nodes n ON r.containing_node_id = n.id GROUP BY ALL")(lambda g: _held(g))


def _held(g: Graph) -> DataFrame:
    """Each join and sum in as many parts as there are references."""
    n = g.refs.count()
    r = spread(g.refs.select("name", "file_id", "containing_node_id"), "file_id", rows=n)
    r = r.join(g.files.select(F.col("id").alias("fid"), "path"), F.col("file_id") == F.col("fid"), "left").select("name", "path", "containing_node_id")
    r = spread(r, "containing_node_id", rows=n).join(g.nodes.select(F.col("id").alias("nid"), F.col("name").alias("holder")), F.col("containing_node_id") == F.col("nid"), "left")
    return spread(r.select("name", "path", "holder"), "name", "path", "holder", rows=n).groupBy("name", "path", "holder").agg(F.count(F.lit(1)).alias("n"))



query("D5_siblings", f"SELECT DISTINCT n.name FROM g_edges a JOIN g_edges b ON a.src_id = b.src_id JOIN g_nodes n ON n.id = b.dst_id WHERE a.kind = 'contains' AND b.kind = 'contains' AND a.dst_id = {ORDER}")(lambda g: fields.sibling_names(g, ORDER))
query("D6_postings", "SELECT id, name FROM g_nodes WHERE list_contains(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), 'widget')")(lambda g: g.nodes.join(text.node_tokens(g).where("field = 'name' AND token = 'widget'").select(F.col("node_id").alias("id")).distinct(), "id").select("id", "name"))
query("D7_content_files", "SELECT f.path, count(*) AS n FROM g_lines l JOIN g_files f ON l.file_id = f.id GROUP BY 1")(lambda g: g.lines.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("path").agg(F.count(F.lit(1)).alias("n")))
query("D8_anti", "SELECT id FROM g_nodes n WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.dst_id = n.id)")(lambda g: g.nodes.select("id").join(g.edges.select(F.col("dst_id").alias("id")), "id", "left_anti"))
query("D9_semi", "SELECT id FROM g_nodes n WHERE EXISTS (SELECT 1 FROM g_edges e WHERE e.dst_id = n.id AND e.kind = 'calls')")(lambda g: g.nodes.select("id").join(g.edges.where("kind = 'calls'").select(F.col("dst_id").alias("id")), "id", "left_semi"))


@query("D10_containment", "SELECT inner_id, outer_id FROM (SELECT a.id AS inner_id, b.id AS outer_id, row_number() OVER (PARTITION BY a.id ORDER BY b.end_line - b.start_line, b.id) AS rn FROM g_nodes a JOIN g_nodes b ON a.file_id = b.file_id AND b.kind = 'class' AND b.start_line <= a.start_line AND b.end_line >= a.end_line WHERE a.kind = 'function') WHERE rn = 1")
def _contained(g: Graph) -> DataFrame:
    a = g.nodes.where("kind = 'function'").select(F.col("id").alias("inner_id"), "file_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    b = g.nodes.where("kind = 'class'").select(F.col("id").alias("outer_id"), "file_id", "start_line", "end_line")
    both = a.join(b, "file_id").where("start_line <= s AND end_line >= e")
    return paging.best_per(both, ["inner_id"], [F.col("end_line") - F.col("start_line"), F.col("outer_id")]).select("inner_id", "outer_id")


query("D12_priority_lookup", "SELECT r.name, min(n.id) AS target FROM (SELECT DISTINCT split_part(name, '.', 2) AS name FROM g_refs WHERE kind = 'call') r JOIN g_nodes n ON n.name = r.name GROUP BY 1")(lambda g: g.refs.where("kind = 'call'").select(S.last_part(F.col("name")).alias("name")).distinct().join(paging.best_per(g.nodes.select("name", F.col("id").alias("target")), ["name"], [F.col("target")]), "name").select("name", "target"))
query("D14_counts_by_root", "SELECT coalesce(root_id, 0) AS root_id, count(*) AS n FROM g_files GROUP BY 1")(lambda g: g.files.groupBy(F.coalesce("root_id", F.lit(0)).alias("root_id")).agg(F.count(F.lit(1)).alias("n")))
_WEIGHTED = "SELECT containing_node_id AS node_id, name, CASE WHEN sum((evidence = 'this_member_write')::INT) > 0 AND sum((evidence <> 'this_member_write')::INT) > 0 THEN 1.5::DOUBLE WHEN sum((evidence = 'this_member_write')::INT) > 0 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS w FROM g_refs WHERE kind = 'field_access' GROUP BY 1, 2"

# ---- E: candidate call sites
_T = "widget"
query("E2_match_set", f"SELECT name, start_line, start_col, containing_node_id FROM g_refs WHERE kind = 'call' AND (lower(name) = '{_T}' OR ends_with(lower(name), '.{_T}') OR ends_with(lower(name), '::{_T}') OR ends_with(lower(name), '->{_T}'))")(lambda g: calls.matching_refs(g, _T).select("name", "start_line", "start_col", "containing_node_id"))
_SITES = f"""target AS (SELECT name, split_part(qualname, '.', 1) AS owner, id % 4 AS sig FROM g_nodes WHERE id = {PART}),
sites AS (SELECT * FROM (SELECT r.*, f.path, n.name AS caller_name, n.qualname AS caller_qualname FROM (SELECT r.*, f.path AS p FROM g_refs r JOIN g_files f ON r.file_id = f.id, target t WHERE r.kind = 'call' AND ends_with(r.name, '.' || t.name) ORDER BY f.path, start_line, start_col, r.name, containing_node_id LIMIT 200) r JOIN g_files f ON r.file_id = f.id LEFT JOIN g_nodes n ON r.containing_node_id = n.id) QUALIFY row_number() OVER (PARTITION BY path, start_line, start_col, name ORDER BY containing_node_id) = 1),
bounds AS (SELECT CASE sig WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS lo, sig AS hi, CASE sig WHEN 0 THEN '' WHEN 1 THEN 'number' WHEN 2 THEN 'number,string' ELSE 'number,string,bool' END AS pat FROM target),
scored AS (SELECT s.path, s.start_line, s.start_col, s.name AS callee_text, s.caller_name, s.arg_count, (split_part(s.name, '.', 1) = t.owner) AS own, least(0.99::DOUBLE, CASE WHEN split_part(s.name, '.', 1) = t.owner THEN 0.90::DOUBLE ELSE 0.40::DOUBLE END + 0.06 + CASE WHEN s.arg_pattern <> '' AND s.arg_pattern = b.pat THEN 0.04 ELSE 0 END) AS confidence, s.arg_pattern <> '' AND s.arg_pattern = b.pat AS bonus FROM sites s, target t, bounds b WHERE s.arg_count BETWEEN b.lo AND b.hi)"""
query("E5_scored_sites", f", {_SITES} SELECT path, start_line, start_col, callee_text, caller_name, round(confidence, 6) AS confidence, CASE WHEN own THEN 'receiver_exact_target_owner' ELSE 'unrelated_member_suffix_match' END || '+arity_match' || CASE WHEN bonus THEN '+arg_pattern' ELSE '' END AS heuristic FROM scored")(lambda g: calls.callsite_scores(g, PART).select("path", "start_line", "start_col", F.col("name").alias("callee_text"), "caller_name", F.round("confidence", 6).alias("confidence"), "heuristic"))
query("E7_heuristic_buckets", f", {_SITES} SELECT CASE WHEN own THEN 'receiver_exact_target_owner' ELSE 'unrelated_member_suffix_match' END || '+arity_match' || CASE WHEN bonus THEN '+arg_pattern' ELSE '' END AS value, count(*) AS n FROM scored GROUP BY 1")(lambda g: calls.candidate_buckets(calls.callsite_scores(g, PART))["heuristic"])
_COST = "160 + octet_length(CAST(callee_text AS BLOB)) + octet_length(CAST(path AS BLOB)) + octet_length(CAST(coalesce(caller_name, '') AS BLOB))"
query("E8_candidate_budget", f", {_SITES}, o AS (SELECT *, {_COST} AS cost FROM scored ORDER BY confidence DESC, path, start_line, start_col, callee_text LIMIT 20), p AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(cost + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WINDOW w AS (ORDER BY confidence DESC, path, start_line, start_col, callee_text)) SELECT path AS file_path, start_line, start_col, callee_text FROM p WHERE rn = 1 OR 256 + before + cost <= 2500")(lambda g: calls.callsite_candidates(g, PART, max_bytes=2500).select("file_path", "start_line", "start_col", "callee_text"))
query("E9_candidate_counts", f", {_SITES} SELECT (SELECT count(*) FROM g_refs r, target t WHERE r.kind = 'call' AND ends_with(r.name, '.' || t.name)) AS candidate_total, (SELECT count(*) FROM scored) AS scored, (SELECT count(*) FROM g_refs r, target t WHERE r.kind = 'call' AND ends_with(r.name, '.' || t.name)) - 20 AS filtered_hidden")(lambda g: calls.candidate_meta(g, PART, calls.callsite_scores(g, PART), 20))

# ---- F: aggregations
query("F2_root_stats", "SELECT coalesce(f.root_id, 0) AS root_id, count(DISTINCT f.id) AS files, count(n.id) AS symbols, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS edges FROM g_files f LEFT JOIN g_nodes n ON n.file_id = f.id LEFT JOIN (SELECT src_id, count(*) AS n FROM g_edges GROUP BY 1) d ON d.src_id = n.id GROUP BY 1")(lambda g: listing.root_stats(g))
query("F3_edges_by_id_range", "SELECT src_id // 1000000000 AS root_id, count(*) AS edges FROM g_edges GROUP BY 1")(lambda g: listing.edges_per_root(g))
query("F4_in_degree", "SELECT dst_id, count(*) AS cnt FROM g_edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")(lambda g: listing.in_degrees(g).orderBy(F.desc("cnt"), "dst_id").limit(25))
query("F5_subdirectories", "SELECT DISTINCT 'src3/' || split_part(path, '/', 2) || '/' AS path FROM g_files WHERE path GLOB 'src3/*'")(lambda g: listing.dir_list(g, "src3").where("type = 'dir'").select("path"))
query("F6_field_use", "SELECT containing_node_id AS node_id, name, CAST(sum((evidence <> 'this_member_write')::INT) AS BIGINT) AS reads, CAST(sum((evidence = 'this_member_write')::INT) AS BIGINT) AS writes, min(start_line) AS first_line FROM g_refs WHERE kind = 'field_access' GROUP BY 1, 2")(lambda g: fields.field_use(g))
query("F7_method_calls", f"SELECT name, 'external' AS relationship, count(*) AS count, min(start_line) AS first_line FROM g_refs WHERE kind = 'call' AND containing_node_id = {ORDER} GROUP BY 1")(lambda g: fields.method_calls(g, ORDER))
query("F8_group_by_module", f"SELECT regexp_replace(n.file_path, '/[^/]*$', '') AS \"group\", count(*) AS n, array_to_string(list_sort(list(n.name)), ',') AS names FROM g_edges e JOIN nf n ON e.src_id = n.id WHERE e.dst_id = {PART} AND e.kind = 'calls' GROUP BY 1")(lambda g: calls.grouped(calls.callers(g, PART), "module"))
query("F10_counters", f"SELECT count(*) AS total_candidates, CAST(sum((ok)::INT) AS BIGINT) AS total, CAST(sum((NOT ok)::INT) AS BIGINT) AS filtered_hidden, CAST(0 AS BIGINT) AS hidden_public_count FROM (SELECT coalesce((end_line - start_line + 1 >= 8) OR {_PUBLIC}, false) AS ok FROM g_nodes)")(lambda g: listing.symbol_list_meta(g.located(), 8))
query("F13_extractability", "SELECT containing_node_id AS node_id, CAST(sum((evidence <> 'this_member_write')::INT) AS BIGINT) AS reads, CAST(sum((evidence = 'this_member_write')::INT) AS BIGINT) AS writes, round(sum((evidence <> 'this_member_write')::INT) / count(*), 6) AS extractability FROM g_refs WHERE kind = 'field_access' GROUP BY 1")(lambda g: fields.extractability(g).withColumn("extractability", F.round("extractability", 6)))
query("F16_confidence_stats", f"SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence, max(confidence) AS max_confidence FROM g_edges WHERE dst_id = {PART}")(lambda g: answers.candidate_stats(g.edges.where(F.col("dst_id") == PART)).withColumn("avg_confidence", F.round("avg_confidence", 6)))

# ---- G: tools
query("G2_repo_stats", "SELECT (SELECT count(*) FROM g_files) AS file_count, (SELECT count(*) FROM g_nodes) AS symbol_count, (SELECT count(*) FROM g_edges) AS edge_count, '2024-01-01T00:00:00Z' AS last_index_time")(lambda g: listing.repo_stats(g))
query("G3_file_search", "SELECT id AS file_id, path, language, size_bytes FROM g_files WHERE (path GLOB 'doc_1*.py' OR split_part(path, '/', 3) GLOB 'doc_1*.py') ORDER BY path LIMIT 50")(lambda g: listing.file_search_page(g, "doc_1*.py"))
query("G5_dir_tree", "SELECT p AS path, CAST(d AS INT) AS depth, 'dir' AS type, count(*) AS children_count, d = 2 AS truncated FROM (SELECT split_part(path, '/', 1) AS p, 1 AS d FROM g_files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM g_files) GROUP BY ALL")(lambda g: listing.dir_tree(g, ".", 2))
query("G6_symbol_search", "SELECT id AS node_id, kind, name, qualname, file_path, start_line, end_line FROM nf WHERE contains(' ' || lower(name), ' widget') ORDER BY length(name), name, file_path, start_line, id LIMIT 50")(lambda g: listing.symbol_search(g, "Widget"))
_LCOST = "64 + octet_length(CAST(kind AS BLOB)) + octet_length(CAST(name AS BLOB)) + coalesce(octet_length(CAST(signature AS BLOB)), 0) + coalesce(octet_length(CAST(file_path AS BLOB)), 0)"
query("G7_symbol_list", f", o AS (SELECT *, {_LCOST} AS cost FROM nf WHERE kind = 'method' AND (end_line - start_line + 1 >= 5 OR {_PUBLIC}) ORDER BY file_path, start_line, id LIMIT 100), p AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(cost + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WINDOW w AS (ORDER BY file_path, start_line, id)) SELECT kind, name, signature, file_path AS file, start_line FROM p WHERE rn = 1 OR 384 + before + cost <= 4000")(lambda g: listing.symbol_list(listing.candidates_of(g, ["method"]), 5, 100, 0, 4000))
query("G8_symbols_in_path", "SELECT kind, name, signature, file_path AS file, start_line FROM nf WHERE file_path GLOB 'src3/en/*' AND kind IN ('class', 'method') ORDER BY file_path, start_line, id LIMIT 200")(lambda g: listing.symbol_list(listing.symbols_in_path(g, "src3/en", ["class", "method"]), max_bytes=0))
query("G10_symbol_batch", f"SELECT CAST(pos AS INT) AS pos, id AS node_id, kind, name, file_path FROM nf JOIN (VALUES (0, {PART}), (1, {ORDER}), (3, {CUSTOMER})) v(pos, vid) ON id = vid")(lambda g: context.symbol_get(g, [PART, ORDER, 99, CUSTOMER]).select("pos", "node_id", "kind", "name", "file_path"))
query("G12_callees", f"SELECT n.id AS callee_node_id, n.name AS callee_name, n.qualname, n.signature, n.file_path, e.confidence FROM g_edges e JOIN nf n ON e.dst_id = n.id WHERE e.src_id = {ORDER} AND e.kind = 'calls' ORDER BY e.confidence DESC, n.id LIMIT 50")(lambda g: calls.callees_page(g, ORDER))
query("G13_references", f"SELECT CAST(NULL AS BIGINT) AS ref_id, r.kind, r.name, f.path AS file_path, r.start_line, r.start_col FROM g_refs r JOIN g_files f ON r.file_id = f.id WHERE resolved_node_id = {PART} ORDER BY f.path, start_line, start_col LIMIT 50")(lambda g: calls.references(g, PART))
_ANY = "(SELECT path FROM g_files WHERE id = 3)"
query("G14_file_summary", f"SELECT id AS node_id, kind, name, qualname, visibility, signature, start_line, end_line FROM nf WHERE file_path = {_ANY}")(lambda g: listing.file_summary(g, g.files.where("id = 3").first()["path"]))
query("G15_file_overview", f", m AS (SELECT name, qualname, kind, start_line, max(end_line) AS end_line, min(signature) AS signature, min(visibility) AS visibility, min(doc) AS doc FROM nf WHERE file_path = {_ANY} AND kind IN ('class','struct','interface','enum','function','method','namespace') GROUP BY 1, 2, 3, 4) SELECT name, qualname, kind, start_line, end_line, end_line - start_line + 1 AS span_lines, signature, visibility, trim(split_part(doc, chr(10), 1)) AS doc FROM m WHERE NOT EXISTS (SELECT 1 FROM m h WHERE h.kind IN ('function','method') AND h.start_line < m.start_line AND h.end_line >= m.end_line)")(lambda g: listing.file_overview(g, g.files.where("id = 3").first()["path"]))
query("G16_context_siblings", f"SELECT n.id AS node_id, n.kind, n.name, n.start_line FROM g_edges a JOIN g_edges b ON a.src_id = b.src_id AND b.kind = 'contains' JOIN g_nodes n ON n.id = b.dst_id WHERE a.kind = 'contains' AND a.dst_id = {ORDER} AND n.id <> {ORDER} ORDER BY n.start_line, n.id LIMIT 30")(lambda g: context.context_for(g, ORDER)["siblings"])
query("G17_symbols_named", "SELECT id AS node_id, name, qualname, kind, file_path, start_line FROM nf WHERE node_type = 'symbol' AND name = 'widget' ORDER BY length(name), length(qualname), file_path, start_line, id LIMIT 25")(lambda g: context.symbols_named(g, "widget"))
query("G18_entrypoints", "SELECT n.id AS node_id, kind, name, file_path, start_line, end_line, 'high_in_degree' AS reason FROM nf n JOIN (SELECT dst_id, count(*) AS c FROM g_edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) d ON n.id = d.dst_id WHERE node_type = 'symbol'")(lambda g: listing.entrypoints(g))
query("G19b_reverse_reach")(lambda g: traverse.reach(traverse.backward(g, ()), traverse.one(g, PART), 3).select("node_id", "distance"))
ORACLES["G19b_reverse_reach"] = PRELUDE.replace("WITH g_files", "WITH RECURSIVE g_files", 1) + f", r(node_id, distance) AS (SELECT CAST({PART} AS BIGINT), 0 UNION SELECT e.src_id, r.distance + 1 FROM r JOIN g_edges e ON e.dst_id = r.node_id WHERE r.distance < 3) SELECT node_id, min(distance) AS distance FROM r GROUP BY 1"
query("G21_file_deps", f", me AS (SELECT id FROM g_nodes WHERE node_type = 'file' AND name = {_ANY}) SELECT DISTINCT 'includes' AS direction, n.name AS path FROM g_edges e JOIN me ON e.src_id = me.id JOIN g_nodes n ON n.id = e.dst_id WHERE e.kind = 'includes' UNION SELECT DISTINCT 'included_by', n.name FROM g_edges e JOIN me ON e.dst_id = me.id JOIN g_nodes n ON n.id = e.src_id WHERE e.kind = 'includes'")(lambda g: traverse.file_deps(g, g.files.where("id = 3").first()["path"]))
query("G22_subgraph_edges", f"SELECT src_id, dst_id, kind, confidence FROM g_edges WHERE src_id = {CUSTOMER} UNION ALL SELECT e.src_id, e.dst_id, e.kind, e.confidence FROM g_edges e WHERE e.kind = 'contains' AND e.src_id IN (SELECT dst_id FROM g_edges WHERE src_id = {CUSTOMER})")(lambda g: traverse.subgraph(g, [CUSTOMER], 2, ["contains"])["edges"])
query("G23_shortest_path", f"SELECT 1 AS path_no, CAST(step AS INT) AS step, node_id, edge_kind FROM (SELECT 0 AS step, CAST({CUSTOMER} AS BIGINT) AS node_id, 'contains' AS edge_kind UNION ALL SELECT 1, src_id, CAST('contains' AS VARCHAR) FROM g_edges WHERE dst_id = {CUSTOMER} UNION ALL SELECT 2, b.src_id, NULL FROM g_edges a JOIN g_edges b ON a.src_id = b.dst_id AND b.kind = 'contains' WHERE a.dst_id = {CUSTOMER})")(lambda g: traverse.shortest_path(g, CUSTOMER, g.edges.where(F.col("dst_id") == g.edges.where(F.col("dst_id") == CUSTOMER).first()["src_id"]).where("kind = 'contains'").first()["src_id"]).select("path_no", "step", "node_id", "edge_kind"))
query("G25_method_fields", "SELECT name, CAST(sum((evidence <> 'this_member_write')::INT) AS BIGINT) AS reads, CAST(sum((evidence = 'this_member_write')::INT) AS BIGINT) AS writes, min(start_line) AS first_line FROM g_refs WHERE kind = 'field_access' AND containing_node_id = 7000000003 GROUP BY 1")(lambda g: fields.field_use(g, 7_000_000_003).drop("node_id"))


@query("G26_clusters")
def _clusters(g: Graph) -> DataFrame:
    users = g.refs.where("kind = 'field_access'").select(F.col("containing_node_id").alias("id"), F.lit("method").alias("kind"), F.concat(F.lit("m"), F.col("containing_node_id")).alias("name"), (F.col("containing_node_id") % 7).alias("file_id"), (F.col("containing_node_id") % 10**9).cast("int").alias("start_line"), (F.col("containing_node_id") % 10**9).cast("int").alias("end_line")).distinct()
    return fields.dependency_clusters(g.with_tables(nodes=conform(users, "nodes")))


@raw("G27_source_at", "SELECT CAST(doc_id AS VARCHAR) AS path, 1 AS start_line, 2 AS end_line, array_to_string(list_transform(list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1, 2), lambda x: x || chr(10)), '') AS source FROM documents WHERE doc_id = 3")
def _source_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    return text.source_at(d, "3", 1, 2)


query("G31_workspace_remove", "SELECT id, path FROM g_files WHERE root_id IS NULL OR root_id <> 2")(lambda g: maintain.workspace_remove(g, "/roots/r2").files.select("id", "path"))
query("G32_workspace_list", "SELECT r AS root_id, '/roots/r' || r AS path, (SELECT count(*) FROM g_files WHERE root_id = r) AS file_count, (SELECT count(*) FROM g_nodes WHERE node_type = 'symbol' AND id // 1000000000 = r) AS symbol_count, (SELECT count(*) FROM g_edges WHERE src_id // 1000000000 = r) AS edge_count FROM (SELECT unnest([1, 2, 3])::BIGINT AS r)")(lambda g: maintain.workspace_list(g))
query("G33_doctor", "SELECT 'refs.containing_node_id -> nodes' AS \"check\", count(*) AS n FROM g_refs r WHERE NOT EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = r.containing_node_id)")(lambda g: maintain.violations(g))

# ---- H: windows, pages, sets
query("H1_best_per_name", "SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY is_definition DESC, id) AS rn FROM g_nodes) WHERE rn = 1")(lambda g: paging.best_per(g.nodes.select("name", "id", "is_definition"), ["name"], [F.desc("is_definition"), F.col("id")]).select("name", "id"))
query("H3_collision_ordinals", "SELECT id, name || CASE WHEN rn > 1 THEN '#' || rn ELSE '' END AS key FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY start_line, id) AS rn FROM g_nodes WHERE kind = 'function')")(lambda g: resolve.stable_keys(g.nodes.where("kind = 'function'").select("id", F.lit("").alias("path"), F.lit("").alias("kind"), F.col("name").alias("qualname"), "name", "start_line", F.col("id").alias("ordinal"))).select("id", F.regexp_replace("stable_key", "^::::", "").alias("key")))
query("H4_budget", "SELECT id FROM (SELECT id, row_number() OVER w AS rn, coalesce(sum(length(path) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, length(path) AS cost FROM g_files WINDOW w AS (ORDER BY id)) WHERE rn <= 1000 AND (rn = 1 OR 384 + before + cost <= 2000)")(lambda g: paging.budget_prefix(g.files.select("id", "path"), [F.col("id")], F.length("path").cast("bigint"), 2000, limit=1000).select("id"))
query("H5_page_meta", "SELECT count(*) AS total, count(*) > 150 AS has_more, CASE WHEN count(*) > 150 THEN CAST(150 AS BIGINT) END AS next_offset FROM g_files")(lambda g: paging.page_meta(g.files, 100, 50))
query("H6_multi_key_sort", "SELECT id, name FROM nf WHERE kind = 'function' ORDER BY length(name), name, file_path, start_line, id LIMIT 40")(lambda g: g.located().where("kind = 'function'").orderBy(F.length("name"), "name", "file_path", "start_line", "id").limit(40).select("id", "name"))
query("H7_top_k", "SELECT name, count(*) AS n FROM g_refs WHERE kind = 'call' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")(lambda g: paging.top_k(g.refs.where("kind = 'call'").groupBy("name").agg(F.count(F.lit(1)).alias("n")), "n", "name", 8))
query("H8_first_groups", "SELECT file_id, CAST(line_no AS INT) AS line_no FROM (SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn, dense_rank() OVER (ORDER BY file_id) AS fr FROM g_lines) WHERE rn <= 3 AND fr <= 10")(lambda g: paging.first_groups(g.lines.select("file_id", "line_no"), "file_id", [F.col("line_no")], 10, 3))
query("H12_both_directions", f"SELECT dst_id AS id FROM g_edges WHERE src_id = {CUSTOMER} UNION ALL SELECT src_id FROM g_edges WHERE dst_id = {CUSTOMER}")(lambda g: g.edges.where(F.col("src_id") == CUSTOMER).select(F.col("dst_id").alias("id")).union(g.edges.where(F.col("dst_id") == CUSTOMER).select("src_id")))
query("H14_set_difference", "SELECT name FROM g_nodes WHERE kind = 'function' EXCEPT SELECT split_part(name, '.', 1) FROM g_refs")(lambda g: g.nodes.where("kind = 'function'").select("name").subtract(g.refs.select(F.split_part("name", F.lit("."), F.lit(1)))))
query("H15_range_lines", "SELECT id, CAST(unnest(range(start_line, end_line + 1)) AS INT) AS line FROM g_nodes WHERE kind = 'namespace'")(lambda g: g.nodes.where("kind = 'namespace'").select("id", F.explode(F.sequence("start_line", "end_line")).alias("line")))


# ---- R: maintenance
@query("R1_change_detection", "SELECT path, CASE WHEN id % 11 = 0 THEN 'deleted' WHEN id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM g_files WHERE root_id IS NULL UNION ALL SELECT 'new/' || path, 'new' FROM g_files WHERE root_id IS NULL AND id % 5 = 0")
def _detect(g: Graph) -> DataFrame:
    main = g.files.where("root_id IS NULL")
    now = main.where("id % 11 <> 0").select(F.col("path").alias("relative_path"), "size_bytes", F.expr("CASE WHEN id % 7 = 0 THEN mtime_ns + 1 ELSE mtime_ns END").alias("mtime_ns"))
    now = now.unionByName(main.where("id % 5 = 0").select(F.concat(F.lit("new/"), "path").alias("relative_path"), "size_bytes", "mtime_ns"))
    return maintain.detect(now, g.files)


query("R2_quarantine_filter", "SELECT path FROM g_files WHERE id % 3 <> 0")(lambda g: maintain.without_quarantined(g.files.select("path"), g.files.where("id % 3 = 0").select("path"), "path"))
query("R9_prune", "SELECT id FROM g_nodes WHERE (file_id IS NULL OR NOT (file_id % 8 = 4)) AND NOT (node_type = 'file' AND id > 8000000000 AND id % 8 = 4)")(lambda g: maintain.drop_files(g.with_tables(files=g.files.withColumn("root_id", F.lit(None).cast("bigint"))), g.files.where("id % 8 = 4").select("path")).nodes.select("id"))
query("R10_force_clear", "SELECT id, path FROM g_files WHERE root_id IS NOT NULL")(lambda g: maintain.force_clear(g).files.select("id", "path"))
_BEST = "best AS (SELECT name, file_id, min(id) AS id, max(is_definition) AS d FROM (SELECT *, row_number() OVER (PARTITION BY name, file_id ORDER BY is_definition DESC, id) AS rn FROM g_nodes WHERE node_type = 'symbol') WHERE rn = 1 GROUP BY 1, 2)"
query("R11_resolve_calls", f", {_BEST}, c AS (SELECT DISTINCT file_id, name FROM g_refs WHERE kind = 'call'), h AS (SELECT c.file_id, c.name, b.id, row_number() OVER (PARTITION BY c.file_id, c.name ORDER BY b.d DESC, b.id) AS rn FROM c JOIN best b ON b.name = split_part(c.name, '.', 2) AND b.file_id <> c.file_id) SELECT file_id, name, id AS target FROM h WHERE rn = 1")(lambda g: _resolved(g))


def _resolved(g: Graph) -> DataFrame:
    r = materialize(g.refs.where("kind = 'call'").select("file_id", "name").distinct().withColumn("id", F.xxhash64("file_id", "name")).withColumn("kind", F.lit("call")), "calls")
    out = resolve.resolve_calls(g.with_tables(refs=conform(r, "refs")))
    return out.join(spread(r.select(F.col("id").alias("ref_id"), "file_id", "name"), "ref_id"), "ref_id").select("file_id", "name", "target")


query("R14_symbol_index", "SELECT id AS node_id, CAST(unnest(range(len(t))) AS INT) AS pos, unnest(t) AS token FROM (SELECT id, list_filter(regexp_split_to_array(lower(signature), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM g_nodes WHERE signature IS NOT NULL)")(lambda g: text.node_tokens(g).where("field = 'signature'").select("node_id", "pos", "token"))
query("R15_overlap", "SELECT '/roots/r' || r AS path, 'inside the new root' AS warning FROM (SELECT unnest([1, 2, 3]) AS r)")(lambda g: maintain.overlap_warnings(g.roots, "/roots"))

# ---- K: streams
_EV = "SELECT *, CASE WHEN event_type = 'error' THEN 'src/.git/HEAD' ELSE 'src/f' || user_id || '.py' END AS path FROM events"
raw("K2_event_types", f"SELECT event_id, CASE WHEN event_type = 'error' THEN 'BranchSwitch' WHEN event_type = 'signup' THEN 'Created' WHEN event_type = 'purchase' THEN 'Deleted' ELSE 'Modified' END AS type FROM ({_EV})")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("path", F.expr("CASE WHEN event_type = 'error' THEN 'src/.git/HEAD' ELSE concat('src/f', user_id, '.py') END")).select("event_id", watch.event_type(F.col("path"), F.col("event_type") != "signup", F.col("event_type") != "purchase").alias("type")))
raw("K3_relevance", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")(lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("path", F.expr("CASE event_type WHEN 'error' THEN '.git/objects/x' WHEN 'view' THEN 'a/.loomgraph/v1' ELSE 'a/b' END")).where(watch.is_relevant(F.col("path"))).select("event_id"))
raw("K4_debounce", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")(lambda spark, sf_dir: watch.debounce(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "user_id", "1 hour"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'view'")
    snap = lambda df: df.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("event_id").alias("mtime_ns"))
    return watch.snapshot_events(snap(e.where("event_id % 3 = 0")), snap(e))


raw("K9_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")(lambda spark, sf_dir: watch.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 day", None, "1 hour", "event_type"))

# ---- Y: scoring
_CITED = "SELECT doc_id % 50 AS id, 'f' || (doc_id % 7) || '.py' AS file, CAST(1 + doc_id % 20 AS INT) AS start_line, CAST(4 + doc_id % 20 AS INT) AS end_line FROM documents"
_TRUE = "SELECT DISTINCT doc_id % 50 AS id, 'f' || (doc_id % 5) || '.py' AS file, CAST(3 + doc_id % 10 AS INT) AS start_line, CAST(5 + doc_id % 10 AS INT) AS end_line FROM documents"


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = lambda m, a, b, c: d.select((F.col("doc_id") % 50).alias("id"), F.concat(F.lit("f"), (F.col("doc_id") % m).cast("string"), F.lit(".py")).alias("file"), (F.lit(a) + F.col("doc_id") % c).cast("int").alias("start_line"), (F.lit(b) + F.col("doc_id") % c).cast("int").alias("end_line")).distinct()
    return row(7, 1, 4, 20), row(5, 3, 5, 10)


_LINES = "l AS (SELECT DISTINCT id, file, unnest(range(start_line, end_line + 1)) AS line FROM c), m AS (SELECT DISTINCT id, file, unnest(range(start_line, end_line + 1)) AS line FROM t)"
raw("Y4_line_scores", f"WITH c AS ({_CITED}), t AS ({_TRUE}), {_LINES}, j AS (SELECT coalesce(l.id, m.id) AS id, (l.id IS NOT NULL)::INT AS f, (m.id IS NOT NULL)::INT AS w FROM l FULL JOIN m ON l.id = m.id AND l.file = m.file AND l.line = m.line), s AS (SELECT id, sum(f * w) AS hits, sum(f) AS found, sum(w) AS wanted FROM j GROUP BY 1) SELECT id, CAST(hits AS BIGINT) AS hits, CAST(found AS BIGINT) AS found, CAST(wanted AS BIGINT) AS wanted, round(hits / found, 6) AS precision, round(hits / wanted, 6) AS recall, CASE WHEN hits > 0 THEN round(2 * hits / (found + wanted), 6) ELSE 0.0 END AS f1 FROM s")(lambda spark, sf_dir: answers.line_scores(*_cited(spark, sf_dir)).select("id", "hits", "found", "wanted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]))
raw("Y4_missing_extra", f"WITH c AS (SELECT DISTINCT id, file FROM ({_CITED})), t AS (SELECT DISTINCT id, file FROM ({_TRUE})) SELECT *, 'missing' AS side FROM (SELECT * FROM t EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM c EXCEPT SELECT * FROM t)")(lambda spark, sf_dir: answers.missing_and_extra(*_cited(spark, sf_dir)))
raw("Y5_tool_metrics", "SELECT conv_id AS id, count(*) AS calls, CAST(sum((role = 'user')::INT) AS BIGINT) AS structural, CAST(sum(strlen(text)) AS BIGINT) AS result_bytes, round(sum((role = 'user')::INT) / count(*), 6) AS structural_ratio FROM conversations GROUP BY 1")(lambda spark, sf_dir: answers.tool_metrics(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("id"), F.col("turn").alias("n"), F.expr("CASE WHEN role = 'user' THEN 'symbol_get' ELSE 'shell' END").alias("tool"), F.col("text").alias("result"))).withColumn("structural_ratio", F.round("structural_ratio", 6)))
raw("Y5_rereads", f"WITH r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY file, start_line) AS n, file, start_line, end_line FROM (SELECT DISTINCT * FROM ({_CITED}))), s AS (SELECT *, EXISTS (SELECT 1 FROM r b WHERE b.id = a.id AND b.file = a.file AND b.n < a.n AND b.start_line <= a.end_line AND b.end_line >= a.start_line) AS again FROM r a) SELECT id, count(*) AS reads, CAST(sum(again::INT) AS BIGINT) AS rereads, round(sum(again::INT) / count(*), 6) AS reread_rate FROM s GROUP BY 1")(lambda spark, sf_dir: answers.rereads(_numbered(_cited(spark, sf_dir)[0])).withColumn("reread_rate", F.round("reread_rate", 6)))


def _numbered(rows: DataFrame) -> DataFrame:
    return traverse.rank_in(rows, "id", [F.col("file"), F.col("start_line")]).withColumnRenamed("rank", "n")
