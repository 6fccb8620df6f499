"""Change detection, quarantine, workspaces and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, conform
from loomgraph.operators.paging import best_per
from loomgraph.operators.resolve import cross_root
from loomgraph.schema import ROOT_STRIDE, TABLES, NotFound

KEYS = {"files": "path", "nodes": "stable_key", "roots": "path"}
FOREIGN = [("nodes", "file_id", "files"), ("refs", "file_id", "files"), ("refs", "resolved_node_id", "nodes"), ("refs", "containing_node_id", "nodes"), ("edges", "src_id", "nodes"), ("edges", "dst_id", "nodes")]


def detect(scanned: DataFrame, files: DataFrame, hashes: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(path, status): new, changed, unchanged or deleted files of the main root.

    A known file of equal size and time is unchanged; another is changed
    unless its hash (path, content_hash) is the one stored.
    """
    known = files.where("root_id IS NULL").select(F.col("path"), F.col("size_bytes").alias("s0"), F.col("mtime_ns").alias("m0"), F.col("content_hash").alias("h0"), F.lit(True).alias("known"))
    now = scanned.select(F.col("relative_path").alias("path"), F.col("size_bytes").alias("s1"), F.col("mtime_ns").alias("m1"), F.lit(True).alias("here"))
    both = now.join(known, "path", "full")
    both = both.join(hashes.select("path", F.col("content_hash").alias("h1")), "path", "left") if hashes is not None else both.withColumn("h1", F.lit(None).cast("string"))
    same = (F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")) if not force else F.lit(False)
    equal = F.coalesce(F.col("h0") == F.col("h1"), F.lit(False)) if not force else F.lit(False)
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull(), "new").when(F.coalesce(same, F.lit(False)) | equal, "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def without_quarantined(work: DataFrame, quarantine: DataFrame, path: str = "relative_path") -> DataFrame:
    return work.join(quarantine.select(F.col("path").alias(path)), path, "left_anti")


def quarantine_add(quarantine: DataFrame, crashes: DataFrame) -> DataFrame:
    """The quarantine after crashes (path, error, at): counts add up, first and last times are kept."""
    new = crashes.select("path", F.lit(1).alias("crash_count"), F.col("at").alias("first_crash"), F.col("at").alias("last_crash"), "error")
    both = conform(quarantine, "quarantine").unionByName(conform(new, "quarantine"))
    return conform(both.groupBy("path").agg(F.sum("crash_count").alias("crash_count"), F.min("first_crash").alias("first_crash"), F.max("last_crash").alias("last_crash"), F.max_by("error", "last_crash").alias("error")), "quarantine")


def quarantine_rehab(quarantine: DataFrame, scanned: DataFrame, files: DataFrame) -> DataFrame:
    """The quarantine without files that are unknown or have changed since they were indexed."""
    now = scanned.select(F.col("relative_path").alias("path"), F.col("mtime_ns").alias("m1"), F.col("size_bytes").alias("s1"))
    then = files.select("path", F.col("mtime_ns").alias("m0"), F.col("size_bytes").alias("s0"))
    changed = now.join(then, "path", "left").where("m0 IS NULL OR m0 <> m1 OR s0 <> s1").select("path")
    return quarantine.join(changed, "path", "left_anti")


def drop_files(g: Graph, paths: DataFrame, main_only: bool = True) -> Graph:
    """The graph without files (path), their nodes, file nodes, edges and references; what pointed there points nowhere."""
    files = g.files.where("root_id IS NULL") if main_only else g.files
    gone = files.join(paths.select("path").distinct(), "path", "left_semi").select("id", "path")
    ids = gone.select(F.col("id").alias("file_id"))
    dead = g.nodes.join(ids, "file_id", "left_semi").select("id").unionByName(g.nodes.where("node_type = 'file'").join(gone.select(F.col("path").alias("name")), "name", "left_semi").select("id"))
    anti = lambda df, c: df.join(dead.select(F.col("id").alias(c)), c, "left_anti")
    refs = g.refs.join(ids, "file_id", "left_anti")
    for c in ("resolved_node_id", "containing_node_id"):
        marks = dead.select(F.col("id").alias(c), F.lit(True).alias("__dead"))
        refs = refs.join(marks, c, "left").withColumn(c, F.when(F.col("__dead").isNull(), F.col(c))).drop("__dead")
    return g.with_tables(
        files=g.files.join(gone.select("id"), "id", "left_anti"), nodes=conform(anti(g.nodes, "id"), "nodes"), edges=conform(anti(anti(g.edges, "src_id"), "dst_id"), "edges"), refs=conform(refs, "refs"), lines=g.lines.join(ids, "file_id", "left_anti"),
    )


def force_clear(g: Graph) -> Graph:
    """The graph without the main root; other roots stay."""
    return drop_files(g, g.files.where("root_id IS NULL").select("path"))


def overlap_warnings(roots: DataFrame, path: str) -> DataFrame:
    """(path, warning) of roots that contain, or lie in, a new one."""
    p = F.lit(path.rstrip("/") + "/")
    own = F.concat(F.rtrim(F.regexp_replace("path", "/+$", "")), F.lit("/"))
    return roots.select("path", F.when(F.startswith(own, p), "inside the new root").when(F.startswith(p, own), "contains the new root").alias("warning")).where("warning IS NOT NULL")


def workspace_add(g: Graph, other: Graph, path: str) -> Graph:
    """The graph with another root's tables: ids moved by root, paths made absolute, keys prefixed, calls resolved both ways.

    Adding a root again replaces it.
    """
    path = path.rstrip("/")
    known = g.roots.where(F.col("path") == path).first()
    if known:
        g = workspace_remove(g, path)
        root = known["id"]
    else:
        root = (g.roots.agg(F.max("id")).first()[0] or 0) + 1
    by = root * ROOT_STRIDE
    move = lambda df, *cols: df.withColumns({c: F.col(c) + F.lit(by).cast("bigint") for c in cols})
    absolute = lambda c: F.concat(F.lit(path + "/"), F.col(c))
    mine = other.files.where("root_id IS NULL")
    ids = mine.select(F.col("id").alias("file_id"))
    own = other.nodes.join(ids, "file_id", "left_semi").unionByName(other.nodes.where("node_type = 'file'").join(mine.select(F.col("path").alias("name")), "name", "left_semi").select(*other.nodes.columns))
    files = move(mine, "id").withColumn("path", absolute("path")).withColumn("root_id", F.lit(root).cast("bigint"))
    nodes = move(conform(own, "nodes"), "id", "file_id").withColumn("name", F.when(F.col("node_type") == "file", absolute("name")).otherwise(F.col("name"))).withColumn("stable_key", F.concat(F.lit(path + "/"), F.col("stable_key")))
    edges = move(other.edges, "id", "src_id", "dst_id")
    refs = move(other.refs.join(ids, "file_id", "left_semi").select(*other.refs.columns), "id", "file_id", "resolved_node_id", "containing_node_id")
    lines = move(other.lines.join(ids, "file_id", "left_semi"), "file_id")
    merged = g.with_tables(
        roots=g.roots.unionByName(conform(g.spark.createDataFrame([(root, path)], "id bigint, path string"), "roots")), files=g.files.unionByName(conform(files, "files")), nodes=g.nodes.unionByName(conform(nodes, "nodes")),
        edges=g.edges.unionByName(conform(edges, "edges")), refs=g.refs.unionByName(conform(refs, "refs")), lines=g.lines.unionByName(conform(lines, "lines")),
    )
    found = cross_root(merged, root)
    refs = merged.refs.join(found.select(F.col("ref_id").alias("id"), "target"), "id", "left").withColumn("resolved_node_id", F.coalesce("resolved_node_id", "target")).drop("target")
    new = found.where("src_id IS NOT NULL").groupBy("src_id", F.col("target").alias("dst_id")).agg(F.max("confidence").alias("confidence"))
    new = new.select(F.xxhash64("src_id", "dst_id").alias("id"), "src_id", "dst_id", F.lit("calls").alias("kind"), "confidence", F.lit("workspace_cross_root").alias("evidence"))
    return merged.with_tables(refs=conform(refs, "refs"), edges=merged.edges.unionByName(conform(new, "edges")))


def workspace_remove(g: Graph, path: str) -> Graph:
    """The graph without a root, its rows, and edges and resolutions that lead into it."""
    row = g.roots.where(F.col("path") == path.rstrip("/")).first()
    if not row:
        raise NotFound(f"no root {path}")
    paths = g.files.where(F.col("root_id") == row["id"]).select("path")
    out = drop_files(g, paths, main_only=False)
    return out.with_tables(roots=g.roots.where(F.col("id") != row["id"]))


def workspace_list(g: Graph) -> DataFrame:
    """(root_id, path, file_count, symbol_count, edge_count) of the added roots."""
    count = lambda df, c, name: df.groupBy(F.expr(f"{c} div {ROOT_STRIDE}").alias("root_id")).agg(F.count(F.lit(1)).alias(name))
    files = g.files.where("root_id IS NOT NULL").groupBy("root_id").agg(F.count(F.lit(1)).alias("file_count"))
    out = g.roots.select(F.col("id").alias("root_id"), "path").join(files, "root_id", "left")
    out = out.join(count(g.nodes.where("node_type = 'symbol'"), "id", "symbol_count"), "root_id", "left").join(count(g.edges, "src_id", "edge_count"), "root_id", "left")
    return out.fillna(0, ["file_count", "symbol_count", "edge_count"])


def violations(g: Graph) -> DataFrame:
    """(check, n): rows that point to nothing, repeated keys, values outside vocabularies; no rows if the graph is whole."""
    out = []
    for table, column, to in FOREIGN:
        rows = getattr(g, table).where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
        out.append(rows.join(getattr(g, to).select(F.col("id").alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{table}.{column} -> {to}").alias("check"), "n"))
    for table, key in KEYS.items():
        out.append(getattr(g, table).groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{table}.{key} unique").alias("check"), "n"))
    out.append(g.edges.where("confidence < 0.3 OR confidence IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges.confidence").alias("check"), "n"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.where("n > 0")


def doctor(g: Graph) -> tuple[DataFrame, DataFrame, int]:
    """(violations, counts by table, exit code)."""
    counts = None
    for t in TABLES:
        c = getattr(g, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n")
        counts = c if counts is None else counts.unionByName(c)
    bad = violations(g)
    return bad, counts, int(not bad.isEmpty())


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    return best_per(rows, [key], [F.desc(at)])
