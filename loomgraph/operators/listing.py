"""Listings: files, directories, symbols, summaries, entry points, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions.globs import in_directory, matches_glob, scope_glob
from loomgraph.functions.scalars import base_name, camel_split, first_line, fold_tokens, is_public, listing_cost, spans_at_least
from loomgraph.graph import Graph, kv_get, spread
from loomgraph.operators.paging import budget_prefix, page, shape
from loomgraph.schema import InvalidInput, NotFound, clamp

STRUCTURAL = ("class", "struct", "interface", "enum", "function", "method", "type_alias", "typedef", "namespace", "trait", "constructor_fn")
CALLABLE = ("function", "method")
SYMBOL_ORDER = ("file_path", "start_line", "id")


def repo_stats(g: Graph) -> DataFrame:
    """(file_count, symbol_count, edge_count, last_index_time); nodes count as symbols, file nodes too."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(g.files, "file_count").crossJoin(count(g.nodes, "symbol_count")).crossJoin(count(g.edges, "edge_count"))
    return out.withColumn("last_index_time", F.lit(kv_get(g.kv, "last_index_time")))


def root_stats(g: Graph) -> DataFrame:
    """(root_id, files, symbols, edges) per root; 0 is the main project. Edges count by their source's file."""
    root = F.coalesce(F.col("root_id"), F.lit(0)).alias("root_id")
    f = g.files.select(F.col("id").alias("fid"), root)
    files = f.groupBy("root_id").agg(F.count(F.lit(1)).alias("files"))
    owned = g.nodes.where("file_id IS NOT NULL").select(F.col("id").alias("nid"), F.col("file_id").alias("fid")).join(f, "fid")
    symbols = owned.groupBy("root_id").agg(F.count(F.lit(1)).alias("symbols"))
    edges = g.edges.select(F.col("src_id").alias("nid")).join(owned, "nid").groupBy("root_id").agg(F.count(F.lit(1)).alias("edges"))
    return files.join(symbols, "root_id", "left").join(edges, "root_id", "left").fillna(0, ["symbols", "edges"])


def edges_per_root(g: Graph) -> DataFrame:
    """Edges by the root that their source's id belongs to."""
    return g.edges.groupBy(F.expr("src_id div 1000000000").alias("root_id")).agg(F.count(F.lit(1)).alias("edges"))


def file_search(g: Graph, pattern: str, language: str | None = None) -> DataFrame:
    """Files whose path matches a glob; a pattern without a slash may match the base name instead."""
    hit = matches_glob(F.col("path"), pattern)
    if "/" not in pattern:
        hit = hit | matches_glob(base_name(F.col("path")), pattern)
    rows = g.files.where(hit)
    if language:
        rows = rows.where(F.col("language") == language)
    return rows.select(F.col("id").alias("file_id"), "path", "language", "size_bytes")


def file_search_page(g: Graph, pattern: str, language: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(file_search(g, pattern, language), [F.col("path")], clamp(limit, 1, 500, 50), max(0, offset))


def dir_list(g: Graph, path: str) -> DataFrame:
    """(type, path, language, size_bytes) of a directory's files and subdirectories, which end in a slash."""
    top = path in ("", ".")
    prefix = "" if top else path.rstrip("/") + "/"
    below = g.files.where(F.col("path").startswith(prefix)) if prefix else g.files
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    dirs = below.where(F.instr(rest, "/") > 0).select(F.concat(F.lit(prefix), F.substring_index(rest, "/", 1), F.lit("/")).alias("path")).distinct()
    dirs = dirs.select(F.lit("dir").alias("type"), "path", F.lit(None).cast("string").alias("language"), F.lit(None).cast("bigint").alias("size_bytes"))
    files = g.files.where(in_directory(F.col("path"), path)).select(F.lit("file").alias("type"), "path", "language", "size_bytes")
    return dirs.unionByName(files)


def dir_list_or_roots(g: Graph, path: str) -> DataFrame:
    """As ``dir_list``; the top of a workspace without files of its own lists the roots."""
    rows = dir_list(g, path)
    if path in ("", ".") and rows.isEmpty():
        return g.roots.select(F.lit("root").alias("type"), "path", F.lit(None).cast("string").alias("language"), F.lit(None).cast("bigint").alias("size_bytes"))
    return rows


def dir_tree(g: Graph, path: str = ".", depth: int = 1) -> DataFrame:
    """(path, depth, type, files below, truncated) of a subtree, flat; 0 is as deep as 20."""
    depth = 20 if depth == 0 else clamp(depth, 1, 20, 1)
    prefix = "" if path in ("", ".") else path.rstrip("/") + "/"
    below = g.files.where(F.col("path").startswith(prefix)) if prefix else g.files
    parts = F.split(F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path")), "/")
    each = below.select(parts.alias("parts")).withColumn("n", F.size("parts"))
    each = each.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(depth)))))
    entry = F.concat(F.lit(prefix), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    each = each.select(entry.alias("path"), "depth", F.when(F.col("depth") == F.col("n"), "file").otherwise("dir").alias("type"))
    tree = each.groupBy("path", "depth", "type").agg(F.count(F.lit(1)).alias("children_count"))
    return tree.withColumn("truncated", (F.col("type") == "dir") & (F.col("depth") == depth))


def cap_tree(tree: DataFrame, max_files: int = 500) -> DataFrame:
    """The tree with the deepest levels of files cut until at most ``max_files`` files show."""
    per = tree.where("type = 'file'").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    run = per.withColumn("upto", F.sum("n").over(W.orderBy("depth")))  # one row per level, 20 at most
    last = run.where(F.col("upto") <= max_files).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("last"))
    return tree.crossJoin(F.broadcast(last)).where("type = 'dir' AND depth <= last + 1 OR depth <= last").withColumn("truncated", F.col("truncated") | ((F.col("type") == "dir") & (F.col("depth") > F.col("last")))).drop("last")


def symbol_hits(g: Graph, query: str, kind: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Symbols that a query finds, with a bucket: 0 by words of the name in order, the last as a prefix; 1 by substring.

    Bucket 1 counts only while bucket 0 has fewer than five. '*' or nothing
    lists all. Filters apply before any limit.
    """
    rows = g.located() if file_pattern else g.nodes
    if kind:
        rows = rows.where(F.col("kind").isin(*(CALLABLE if kind == "function" else (kind,))))
    if file_pattern:
        rows = rows.where(matches_glob(F.col("file_path"), file_pattern))
    located = lambda found: found if file_pattern else g.located(found)
    if query.strip() in ("", "*"):
        return located(rows.withColumn("bucket", F.lit(0)))
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    if not words:
        return located(rows.where("false").withColumn("bucket", F.lit(0)))
    phrase = " " + " ".join(words)
    by_words = F.instr(F.concat(F.lit(" "), F.array_join(fold_tokens(camel_split(F.col("name"))), " ")), phrase) > 0
    low = query.lower()
    loose = F.contains(F.lower("name"), F.lit(low)) | F.coalesce(F.contains(F.lower("qualname"), F.lit(low)), F.lit(False))
    few = rows.where(by_words).select(F.lit(1)).limit(5).agg((F.count(F.lit(1)) < 5).alias("few"))
    hits = rows.withColumn("bucket", F.when(by_words, 0).when(loose, 1)).where("bucket IS NOT NULL")
    # files are joined to hits, not to all symbols
    return located(hits.crossJoin(F.broadcast(few)).where("bucket = 0 OR few").drop("few"))


def symbol_search(g: Graph, query: str, kind: str | None = None, file_pattern: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = symbol_hits(g, query, kind, file_pattern)
    order = [F.col(c) for c in SYMBOL_ORDER] if query.strip() in ("", "*") else [F.col("bucket"), F.length("name"), F.col("name"), F.col("file_path"), F.col("start_line"), F.col("id")]
    return page(rows, order, clamp(limit, 1, 500, 50), max(0, offset)).select(F.col("id").alias("node_id"), "kind", "name", "qualname", "file_path", "start_line", "end_line")


def candidates_of(g: Graph, kinds: list[str] | None = None, path: str | None = None, name_glob: str | None = None, recursive: bool = True, directory: str | None = None) -> DataFrame:
    """Located nodes under the structural filters of a listing."""
    rows = g.located()
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if path:
        rows = rows.where(F.col("file_path") == path)
    if directory and directory != ".":
        rows = rows.where(F.col("file_path").startswith(directory.rstrip("/") + "/") if recursive else in_directory(F.col("file_path"), directory))
    elif directory == "." and not recursive:
        rows = rows.where(in_directory(F.col("file_path"), "."))
    if name_glob:
        rows = rows.where(matches_glob(F.col("name"), name_glob))
    return rows


def _passes(min_span_lines: int) -> Column:
    public = is_public(F.col("visibility"), F.col("qualname"), F.col("name"), F.col("kind"))
    return spans_at_least(F.col("start_line"), F.col("end_line"), min_span_lines) | public


def symbol_list(rows: DataFrame, min_span_lines: int = 0, limit: int = 200, offset: int = 0, max_bytes: int = 16_000, compact: bool = False, handles: bool = False) -> DataFrame:
    """A page of candidates long enough or public, within the byte budget."""
    limit, max_bytes = clamp(limit, 1, 2000, 200), clamp(max_bytes, 0, 100_000, 16_000)
    order = [F.col(c) for c in SYMBOL_ORDER]
    part = page(rows.where(_passes(min_span_lines)), order, limit, max(0, offset))
    cost = listing_cost(F.col("kind"), F.col("name"), F.col("signature"), F.col("file_path"))
    return shape(budget_prefix(part, order, cost, max_bytes), compact, handles)


def symbol_list_meta(rows: DataFrame, min_span_lines: int = 0) -> DataFrame:
    """(total_candidates, total, filtered_hidden, hidden_public_count) in one pass."""
    ok = F.coalesce(_passes(min_span_lines), F.lit(False))
    public = is_public(F.col("visibility"), F.col("qualname"), F.col("name"), F.col("kind"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counted = rows.agg(F.count(F.lit(1)).alias("total_candidates"), n(ok).alias("total"), n(~ok).alias("filtered_hidden"), n(~ok & public).alias("hidden_public_count"))
    return counted.fillna(0)


def symbols_in_path(g: Graph, path: str, kinds: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """Candidates in a file or below a directory; '.' is everything. Unknown paths are an error."""
    if path != "." and not g.files.where(F.col("path") == path).isEmpty():
        return candidates_of(g, kinds, path=path)
    if path != "." and g.files.where(F.col("path").startswith(path.rstrip("/") + "/")).isEmpty():
        raise NotFound(f"no such path: {path}")
    return candidates_of(g, kinds, directory=path, recursive=recursive)


def resolve_file(g: Graph, path: str, root: str = "") -> str:
    """The indexed path that a given one means: itself, below the root, or the first that ends in it."""
    rank = F.when(F.col("path") == path, 0).when(F.col("path") == f"{root.rstrip('/')}/{path}", 1).when(F.endswith(F.lower("path"), F.lit("/" + path.lower())), 2)
    row = g.files.select("path", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "path").limit(1).first()
    if not row:
        raise NotFound(f"file not indexed: {path}")
    return row["path"]


def file_summary(g: Graph, path: str) -> DataFrame:
    """Symbols of a file by line."""
    rows = g.located().where(F.col("file_path") == path)
    return rows.select(F.col("id").alias("node_id"), "kind", "name", "qualname", "visibility", "signature", "start_line", "end_line")


def merge_duplicates(rows: DataFrame) -> DataFrame:
    """Located structural symbols, those of one file, name and start line as one that ends with the last of them."""
    kind = F.when(F.col("kind").isin("typedef", "type_alias"), "type").otherwise(F.col("kind"))
    some = lambda c: F.min(F.when(F.col(c) != "", F.col(c))).alias(c)
    rows = rows.where(F.col("kind").isin(*STRUCTURAL)).withColumn("kind", kind)
    return rows.groupBy("file_path", "name", "qualname", "kind", "start_line").agg(F.max("end_line").alias("end_line"), some("signature"), some("visibility"), some("doc"))


def file_overview(g: Graph, path: str) -> DataFrame:
    """Structural symbols of a file: duplicates merged, those inside a kept function or method left out."""
    merged = merge_duplicates(g.located().where(F.col("file_path") == path))
    hosts = merged.where(F.col("kind").isin(*CALLABLE, "constructor_fn")).select(F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("name").alias("host"))
    inside = (F.col("s") < F.col("start_line")) & (F.col("e") >= F.col("end_line"))
    kept = merged.join(hosts, inside, "left_anti")  # one file's symbols: small on both sides
    return kept.select("name", "qualname", "kind", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("span_lines"), "signature", "visibility", first_line(F.col("doc")).alias("doc"))


def in_degrees(g: Graph) -> DataFrame:
    return spread(g.edges.select("dst_id"), "dst_id").groupBy("dst_id").agg(F.count(F.lit(1)).alias("cnt"))


def entrypoints(g: Graph, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Functions named like a program's start, and symbols among the ``limit`` nodes of highest in-degree."""
    limit = clamp(limit, 1, 200, 20)
    mains = g.nodes.where(F.col("name").isin("main", "Main", "wmain") & (F.col("kind") == "function")).withColumn("reason", F.lit("main_function"))
    top = in_degrees(g).orderBy(F.desc("cnt"), "dst_id").limit(limit)
    busy = g.nodes.where("node_type = 'symbol'").join(F.broadcast(top), F.col("id") == F.col("dst_id")).drop("dst_id", "cnt").withColumn("reason", F.lit("high_in_degree"))  # limit rows at most
    busy = busy.join(mains.select("id"), "id", "left_anti")
    found = g.located(mains.unionByName(busy))
    if scope:
        found = found.where(matches_glob(F.col("file_path"), scope_glob(scope)))
    return found.select(F.col("id").alias("node_id"), "kind", "name", "file_path", "start_line", "end_line", "reason")


def find_implementations(g: Graph, symbol: str, limit: int = 50) -> DataFrame:
    """Symbols that inherit from the first ten types of a name."""
    bases = g.nodes.where((F.col("name") == symbol) & F.col("kind").isin("class", "struct", "interface", "type", "trait")).orderBy("id").limit(10).select(F.col("id").alias("base"))
    subs = g.edges.where("kind = 'inherits'").join(F.broadcast(bases), F.col("dst_id") == F.col("base")).select(F.col("src_id").alias("id")).distinct()  # ten rows at most
    rows = g.located().join(subs, "id")
    return page(rows, [F.col("id")], clamp(limit, 1, 500, 50)).select(F.col("id").alias("node_id"), "name", "qualname", "kind", "signature", "file_path")


def resolve_node(g: Graph, node_id: int | None = None, symbol: str | None = None, file: str | None = None) -> int:
    """The node that an id, or a name and a file, mean; definitions first, then the least id."""
    if node_id is not None:
        if g.nodes.where(F.col("id") == node_id).isEmpty():
            raise NotFound(f"no node {node_id}")
        return node_id
    if not symbol:
        raise InvalidInput("node_id or symbol is needed")
    rows = g.located().where(F.col("name") == symbol)
    if file:
        rows = rows.where((F.col("file_path") == file) | F.endswith("file_path", F.lit("/" + file)))
    row = rows.orderBy(F.desc("is_definition"), "id").select("id").first()
    if not row:
        raise NotFound(f"no symbol {symbol}")
    return row["id"]
