"""A code graph made of the star-schema tables, so that every operator has data of any size.

Ids are ``type * 10^9 + key``: 1 regions (file nodes), 2 nations, 3 customers,
4 orders, 5 suppliers, 6 parts, 7 users, 8 document files (file nodes).
Documents are the files; every symbol lies in the file ``key mod documents``.
``PRELUDE`` is the same in DuckDB's SQL, for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, Later, conform, empty_graph, spread
from loomgraph.schema import ROOT_STRIDE
from loomgraph.scratch import materialize

_EXT = "CASE {lang} WHEN 'en' THEN 'py' WHEN 'de' THEN 'cpp' WHEN 'fr' THEN 'ts' ELSE 'go' END"
_LANGUAGE = "CASE {lang} WHEN 'en' THEN 'python' WHEN 'de' THEN 'cpp' WHEN 'fr' THEN 'typescript' ELSE 'go' END"

#: Expressions that both engines read; k is the key, n the number of documents.
_SYMBOL = {
    "file_id": "k % n",
    "start_line": "CAST(1 + k % 97 AS INT)",
    "end_line": "CAST(1 + k % 97 + k % 13 AS INT)",
    "visibility": "CASE k % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE NULL END",
    "is_definition": "CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS INT)",
}
#: Type hints of calls: an interface of the call's own file, of a file that it includes, of any, or none.
_HINT = "CASE l_orderkey % 4 WHEN 0 THEN NULL ELSE concat('Supplier_', lpad(CAST(CASE l_orderkey % 4 WHEN 1 THEN l_orderkey % n WHEN 2 THEN (l_orderkey % n * 7 + 1) % n ELSE l_partkey % 10 END AS {text}), 9, '0')) END"
_SIGNATURE = "CASE k % 4 WHEN 0 THEN concat({name}, '()') WHEN 1 THEN concat({name}, '(int size)') WHEN 2 THEN concat({name}, '(int size, string label)') ELSE concat({name}, '(int size, string label, bool deep = true)') END"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")}


def _id(kind: int, key: str) -> Column:
    return F.lit(kind * ROOT_STRIDE).cast("bigint") + F.col(key)


def files(t: dict[str, DataFrame]) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.expr(_EXT.format(lang="lang")))
    d = t["documents"].select(
        F.col("doc_id").alias("id"), path.alias("path"), F.expr(_LANGUAGE.format(lang="lang")).alias("language"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") * 1000).alias("mtime_ns"),
        F.md5("text").alias("content_hash"), F.expr("CASE WHEN n_chars < 100 THEN 'partial' ELSE 'ok' END").alias("parse_status"), F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 END").alias("root_id"),
    )
    return conform(d, "files")


def nodes(t: dict[str, DataFrame]) -> DataFrame:
    n = t["documents"].agg(F.count(F.lit(1)).alias("n"))  # one row, broadcast

    def symbols(kind: int, table: str, key: str, node_kind: str, name: str, qualname: str = "name", signature: str = "CAST(NULL AS STRING)", doc: str = "CAST(NULL AS STRING)") -> DataFrame:
        rows = t[table].select(F.col(key).cast("bigint").alias("k"), F.expr(name).alias("name"), F.expr(qualname if qualname != "name" else name).alias("qualname"), F.expr(doc).alias("doc")).crossJoin(F.broadcast(n))
        return rows.select(
            _id(kind, "k").alias("id"), F.lit("symbol").alias("node_type"), F.lit(node_kind).alias("kind"), "name", "qualname", "doc", F.expr(signature.format(name="name")).alias("signature"),
            F.concat(F.lit(f"{node_kind}::"), F.col("k").cast("string")).alias("stable_key"), *[F.expr(e).alias(c) for c, e in _SYMBOL.items()],
        )

    parts = [
        symbols(2, "nation", "n_nationkey", "namespace", "n_name"),
        symbols(3, "customer", "c_custkey", "class", "replace(c_name, '#', '_')"),
        symbols(4, "orders", "o_orderkey", "method", "concat('order_', CAST(o_orderkey AS STRING))", signature=_SIGNATURE),
        symbols(5, "supplier", "s_suppkey", "interface", "replace(s_name, '#', '_')"),
        symbols(6, "part", "p_partkey", "function", "split_part(p_name, ' ', 2)", "replace(p_name, ' ', '.')", _SIGNATURE, "concat(p_type, '\n', p_brand)"),
    ]
    regions = t["region"].select(_id(1, "r_regionkey").alias("id"), F.lit("file").alias("node_type"), F.lit("file").alias("kind"), F.col("r_name").alias("name"), F.lit(1).alias("is_definition"), F.concat("r_name", F.lit("::file")).alias("stable_key"))
    docs = files(t).select((F.lit(8 * ROOT_STRIDE).cast("bigint") + F.col("id")).alias("id"), F.lit("file").alias("node_type"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.lit(1).alias("is_definition"), F.concat("path", F.lit("::file")).alias("stable_key"))
    out = conform(regions, "nodes").unionByName(conform(docs, "nodes"))
    for p in parts:
        out = out.unionByName(conform(p, "nodes"))
    return out


def edges(t: dict[str, DataFrame]) -> DataFrame:
    def edge(df: DataFrame, src: Column, dst: Column, kind: str, confidence: Column) -> DataFrame:
        return df.select(src.cast("bigint").alias("src_id"), dst.cast("bigint").alias("dst_id"), F.lit(kind).alias("kind"), confidence.alias("confidence"))

    one, likely = F.lit(1.0), F.lit(0.7)
    li = spread(t["lineitem"], "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q")).sortWithinPartitions("l_partkey")
    s = t["supplier"].join(t["supplier"].groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_suppkey").alias("mk")), F.col("s_nationkey") == F.col("nk")).where("s_suppkey <> mk")
    n = t["nation"].join(t["nation"].groupBy(F.col("n_regionkey").alias("rk")).agg(F.min("n_nationkey").alias("mk")), F.col("n_regionkey") == F.col("rk")).where("n_nationkey <> mk")
    count = t["documents"].agg(F.count(F.lit(1)).alias("n"))
    d = t["documents"].select("doc_id").crossJoin(F.broadcast(count)).withColumn("k", (F.col("doc_id") * 7 + 1) % F.col("n")).where("k <> doc_id")
    parts = t["part"].agg(F.count(F.lit(1)).alias("n"))
    p = t["part"].select("p_partkey").crossJoin(F.broadcast(parts)).withColumn("k", (F.col("p_partkey") * 7 + 3) % F.col("n")).where("k <> p_partkey")  # one row
    found = [
        edge(p, _id(6, "p_partkey"), _id(6, "k"), "calls", F.lit(0.6)),
        edge(t["nation"], _id(1, "n_regionkey"), _id(2, "n_nationkey"), "contains", one),
        edge(t["customer"], _id(2, "c_nationkey"), _id(3, "c_custkey"), "contains", one),
        edge(t["supplier"], _id(2, "s_nationkey"), _id(5, "s_suppkey"), "contains", one),
        edge(t["orders"], _id(3, "o_custkey"), _id(4, "o_orderkey"), "contains", one),
        edge(li, _id(4, "l_orderkey"), _id(6, "l_partkey"), "calls", F.lit(0.3) + F.lit(0.01) * F.col("q")),
        edge(s, _id(5, "s_suppkey"), _id(5, "mk"), "inherits", likely),
        edge(n, _id(2, "n_nationkey"), _id(2, "mk"), "includes", likely),
        edge(d, _id(8, "doc_id"), _id(8, "k"), "includes", likely),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return conform(out, "edges")


def refs(t: dict[str, DataFrame]) -> DataFrame:
    count = F.broadcast(t["documents"].agg(F.count(F.lit(1)).alias("n")))
    li = spread(t["lineitem"], "l_partkey").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    calls = li.join(t["part"], F.col("l_partkey") == F.col("p_partkey")).crossJoin(count).select(
        (F.col("l_orderkey") % F.col("n")).alias("file_id"), F.lit("call").alias("kind"), F.expr("replace(p_name, ' ', '.')").alias("name"), F.col("l_linenumber").cast("int").alias("start_line"),
        (F.col("l_partkey") % 80).cast("int").alias("start_col"), _id(6, "l_partkey").alias("resolved_node_id"), F.lit("call_expression").alias("evidence"), _id(4, "l_orderkey").alias("containing_node_id"),
        F.expr(_HINT.format(text="STRING")).alias("receiver_type_hint"),
        (F.col("q").cast("int") % 4).cast("int").alias("arg_count"), F.expr("CASE CAST(q AS INT) % 4 WHEN 0 THEN '' WHEN 1 THEN 'number' WHEN 2 THEN 'number,string' ELSE 'number,string,bool' END").alias("arg_pattern"),
    )
    fields = t["events"].crossJoin(count).select(
        (F.col("user_id") % F.col("n")).alias("file_id"), F.lit("field_access").alias("kind"), F.col("event_type").alias("name"), (F.col("event_id") % 500).cast("int").alias("start_line"), F.lit(0).alias("start_col"),
        F.expr("CASE WHEN event_type IN ('purchase', 'signup') THEN 'this_member_write' ELSE 'this_member_read' END").alias("evidence"), _id(7, "user_id").alias("containing_node_id"),
    )
    return conform(calls, "refs").unionByName(conform(fields, "refs"))


def byte_prefix(text: Column, n: int) -> Column:
    """The longest prefix of whole characters within ``n`` bytes."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")), "\uFFFD$", "")


def content_lines(texts: DataFrame) -> DataFrame:
    """(file_id, line_no, content, full_line) of the eligible lines of (file_id, text): three word characters at least; content is the prefix of 200 bytes at most."""
    each = texts.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.regexp_replace("line", "\r$", "")
    words = F.length(F.regexp_replace(line, "[^A-Za-z0-9_]", ""))
    cut = F.when(F.octet_length(line) <= 200, line).otherwise(byte_prefix(line, 200))
    return each.where((F.length(line) >= 3) & (words >= 3)).select("file_id", (F.col("pos") + 1).cast("int").alias("line_no"), cut.alias("content"), line.alias("full_line"))


def build(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables below ``sf_dir``; nothing is read until a query needs it."""
    t = tables(spark, sf_dir)
    roots = spark.range(1, 4).select("id", F.concat(F.lit("/roots/r"), F.col("id").cast("string")).alias("path"))
    kv = spark.createDataFrame([("schema_version", "8"), ("last_index_time", "2024-01-01T00:00:00Z"), ("git_head", "abc"), ("git_branch", "main")], "key string, value string")
    lines = lambda: conform(content_lines(t["documents"].select(F.col("doc_id").alias("file_id"), "text")), "lines")
    return empty_graph(spark).with_tables(**{k: Later(make) for k, make in {"files": lambda: files(t), "nodes": lambda: nodes(t), "edges": lambda: edges(t), "refs": lambda: refs(t), "lines": lines}.items()}, roots=conform(roots, "roots"), kv=kv)


_stored: dict[tuple, Graph] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """The session, and size and time of each table: another state of the tables is another graph."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(str(f.getPath().getName()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)]
    return spark.sparkContext.applicationId, sf_dir, tuple(sorted(found))


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables below ``sf_dir``; each table is indexed when a query first reads it, once a session: queries read stored tables, as they would of an indexed tree.

    No table is sorted or dealt out as a whole. Calls lie together by the
    part that is called, in its order, edges and references alike; all other
    rows lie as in the tables they are made of, which are in the order of
    their keys. So scans by these keys skip most pages.
    """
    key = _stamp(spark, sf_dir)
    if key not in _stored:
        g = build(spark, sf_dir)
        _stored[key] = g.with_tables(**{t: Later(lambda t=t: materialize(getattr(g, t), t)) for t in ("files", "nodes", "edges", "refs", "lines")})
    return _stored[key]


def _sql_symbols(kind: int, table: str, key: str, node_kind: str, name: str, qualname: str | None = None, signature: str = "CAST(NULL AS VARCHAR)", doc: str = "CAST(NULL AS VARCHAR)") -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in _SYMBOL.items())
    return f"""SELECT {kind * ROOT_STRIDE}::BIGINT + k AS id, 'symbol' AS node_type, '{node_kind}' AS kind, name, qualname, {signature.format(name='name')} AS signature, doc, '{node_kind}::' || k AS stable_key, {cols}
FROM (SELECT CAST({key} AS BIGINT) AS k, {name} AS name, {qualname or name} AS qualname, {doc} AS doc FROM {table}), (SELECT count(*) AS n FROM documents)"""


_B = "CAST({}000000000 AS BIGINT)"
_file_node = "SELECT {id} AS id, 'file' AS node_type, 'file' AS kind, {name} AS name, NULL AS qualname, NULL AS signature, NULL AS doc, {name} || '::file' AS stable_key, NULL AS file_id, NULL AS start_line, NULL AS end_line, NULL AS visibility, 1 AS is_definition FROM {table}"
PRELUDE = f"""WITH g_files AS (SELECT doc_id AS id, source || '/' || lang || '/doc_' || doc_id || '.' || {_EXT.format(lang='lang')} AS path, {_LANGUAGE.format(lang='lang')} AS language, n_chars AS size_bytes, doc_id * 1000 AS mtime_ns, md5(text) AS content_hash, CASE WHEN n_chars < 100 THEN 'partial' ELSE 'ok' END AS parse_status, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 END AS root_id FROM documents),
g_nodes AS ({' UNION ALL BY NAME '.join([
    _sql_symbols(2, 'nation', 'n_nationkey', 'namespace', 'n_name'), _sql_symbols(3, 'customer', 'c_custkey', 'class', "replace(c_name, '#', '_')"),
    _sql_symbols(4, 'orders', 'o_orderkey', 'method', "'order_' || o_orderkey", signature=_SIGNATURE), _sql_symbols(5, 'supplier', 's_suppkey', 'interface', "replace(s_name, '#', '_')"),
    _sql_symbols(6, 'part', 'p_partkey', 'function', "split_part(p_name, ' ', 2)", "replace(p_name, ' ', '.')", _SIGNATURE, "p_type || chr(10) || p_brand"),
    _file_node.format(id=_B.format(1) + ' + r_regionkey', name='r_name', table='region'), _file_node.format(id=_B.format(8) + ' + id', name='path', table='g_files'),
])}),
g_edges AS (SELECT {_B.format(1)}+n_regionkey AS src_id, {_B.format(2)}+n_nationkey AS dst_id, 'contains' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM nation
UNION ALL SELECT {_B.format(2)}+c_nationkey, {_B.format(3)}+c_custkey, 'contains', 1.0 FROM customer
UNION ALL SELECT {_B.format(2)}+s_nationkey, {_B.format(5)}+s_suppkey, 'contains', 1.0 FROM supplier
UNION ALL SELECT {_B.format(3)}+o_custkey, {_B.format(4)}+o_orderkey, 'contains', 1.0 FROM orders
UNION ALL SELECT {_B.format(4)}+l_orderkey, {_B.format(6)}+l_partkey, 'calls', CAST(0.3 AS DOUBLE)+CAST(0.01 AS DOUBLE)*max(l_quantity) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT {_B.format(6)}+p_partkey, {_B.format(6)}+(p_partkey*7+3)%n, 'calls', CAST(0.6 AS DOUBLE) FROM part, (SELECT count(*) AS n FROM part) WHERE (p_partkey*7+3)%n<>p_partkey
UNION ALL SELECT {_B.format(5)}+s.s_suppkey, {_B.format(5)}+m.mk, 'inherits', CAST(0.7 AS DOUBLE) FROM supplier s JOIN (SELECT s_nationkey, min(s_suppkey) mk FROM supplier GROUP BY 1) m ON s.s_nationkey=m.s_nationkey WHERE s.s_suppkey<>m.mk
UNION ALL SELECT {_B.format(2)}+n.n_nationkey, {_B.format(2)}+m.mk, 'includes', CAST(0.7 AS DOUBLE) FROM nation n JOIN (SELECT n_regionkey, min(n_nationkey) mk FROM nation GROUP BY 1) m ON n.n_regionkey=m.n_regionkey WHERE n.n_nationkey<>m.mk
UNION ALL SELECT {_B.format(8)}+doc_id, {_B.format(8)}+(doc_id*7+1)%n, 'includes', CAST(0.7 AS DOUBLE) FROM documents, (SELECT count(*) AS n FROM documents) WHERE (doc_id*7+1)%n<>doc_id),
g_refs AS (SELECT l_orderkey % n AS file_id, 'call' AS kind, replace(p_name, ' ', '.') AS name, CAST(l_linenumber AS INT) AS start_line, CAST(l_partkey % 80 AS INT) AS start_col, {_B.format(6)}+l_partkey AS resolved_node_id, 'call_expression' AS evidence, {_B.format(4)}+l_orderkey AS containing_node_id, CAST(CAST(q AS INT) % 4 AS INT) AS arg_count, CASE CAST(q AS INT) % 4 WHEN 0 THEN '' WHEN 1 THEN 'number' WHEN 2 THEN 'number,string' ELSE 'number,string,bool' END AS arg_pattern, {_HINT.format(text='VARCHAR')} AS receiver_type_hint
  FROM (SELECT l_orderkey, l_partkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey, (SELECT count(*) AS n FROM documents)
UNION ALL SELECT user_id % n, 'field_access', event_type, CAST(event_id % 500 AS INT), 0, NULL, CASE WHEN event_type IN ('purchase', 'signup') THEN 'this_member_write' ELSE 'this_member_read' END, {_B.format(7)}+user_id, NULL, NULL, NULL FROM events, (SELECT count(*) AS n FROM documents)),
g_lines AS (SELECT file_id, line_no, line AS full_line FROM (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) WHERE length(line) >= 3 AND length(regexp_replace(line, '[^A-Za-z0-9_]', '', 'g')) >= 3),
nf AS (SELECT g_nodes.*, g_files.path AS file_path, g_files.language AS language, g_files.root_id AS root_id FROM g_nodes LEFT JOIN g_files ON g_nodes.file_id = g_files.id)
"""
