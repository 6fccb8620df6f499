"""Graph traversal by levels: each level is one join of the frontier with the edges.

Only ids that were reached move between levels. A level's result is written to
the shared folder, so plans stay small and lost executors lose nothing; the
driver holds counts, and ids only where a caller's limit bounds them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions.globs import matches_path
from loomgraph.graph import Graph
from loomgraph.scratch import materialize
from loomgraph.schema import EDGE_KINDS, InvalidInput, clamp

IMPACT_KINDS = ("function", "method", "class", "interface")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node_id, distance, kind, confidence, via) of nodes reached from the seeds (node_id) along edges (a, b, kind, confidence).

    Seeds have distance 0. Each node counts where it is reached first; among
    edges of that level the most confident, then the least kind and source. With
    ``most`` the walk stops at the end of the level that reaches so many.
    """
    start = seeds.select(F.col("node_id").cast("bigint").alias("node_id")).distinct().select("node_id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("bigint").alias("via"))
    levels = [materialize(start, "reach")]
    total = levels[0].count() if most is not None else 0
    for level in range(1, depth + 1):
        new = materialize(_next_level(edges, levels, level), "reach")
        n = new.count()  # of a stored table: its footers
        total += n
        if n:
            levels.append(new)
        if not n or most is not None and total > most:
            break
    return reduce(DataFrame.unionByName, levels)


def _next_level(edges: DataFrame, levels: list[DataFrame], level: int) -> DataFrame:
    """What the last level's nodes lead to, but for nodes of any level so far."""
    front = levels[-1].select(F.col("node_id").alias("a"))
    seen = reduce(DataFrame.unionByName, [x.select(F.col("node_id").alias("b")) for x in levels])
    step = edges.join(front, "a").join(seen, "b", "left_anti")
    first = step.groupBy("b").agg(F.max_by(F.struct("kind", "confidence", "a"), F.struct(F.col("confidence"), -F.col("a"))).alias("e"))
    return first.select(F.col("b").alias("node_id"), F.lit(level).alias("distance"), "e.kind", "e.confidence", F.col("e.a").alias("via"))


def one(g: Graph, *ids: int) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "node_id bigint")


def backward(g: Graph, but: tuple[str, ...] = ("contains",)) -> DataFrame:
    return g.edges.where(~F.col("kind").isin(*but)).select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "kind", "confidence")


def impact_of(g: Graph, node_id: int, depth: int = 2, max_nodes: int = 50) -> DataFrame:
    """(node_id, name, file_path, relationship, distance) of what depends on a node, nearest first."""
    depth, most = clamp(depth, 1, 3, 2), clamp(max_nodes, 1, 200, 50)
    seen = reach(backward(g), one(g, node_id), depth, most).where("distance > 0")
    top = seen.orderBy("distance", "node_id").limit(most)
    names = g.located().select(F.col("id").alias("node_id"), "name", "file_path")
    return names.join(F.broadcast(top), "node_id").select("node_id", "name", "file_path", F.col("kind").alias("relationship"), "distance")  # max_nodes rows at most


def impacted_files(impacted: DataFrame) -> DataFrame:
    return impacted.select("file_path").where("file_path IS NOT NULL").distinct()


def changed_symbols(g: Graph, changed: DataFrame, file_pattern: str | None = None) -> DataFrame:
    """Functions, methods and types in changed files (path), which may be relative to a root."""
    if file_pattern:
        changed = changed.where(matches_path(F.col("path"), file_pattern))
    f = g.files.select(F.col("id").alias("file_id"), "path")
    hit = f.join(changed.select("path").distinct(), "path")
    n = g.nodes.where(F.col("kind").isin(*IMPACT_KINDS))
    return n.join(hit, "file_id").select(F.col("id").alias("node_id"), "name", "kind", F.col("path").alias("file"))


def detect_changes(g: Graph, changed: DataFrame, file_pattern: str | None = None, depth: int = 2, min_confidence: float = 0.5, most: int = 500) -> DataFrame:
    """(node_id, name, kind, file, distance, confidence) of symbols that call changed ones, over confident calls."""
    depth = clamp(depth, 1, 5, 2)
    calls = g.edges.where((F.col("kind") == "calls") & (F.col("confidence") >= clamp(min_confidence, 0.0, 1.0, 0.5))).select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "kind", "confidence")
    calls = calls.join(g.nodes.where("node_type = 'symbol'").select(F.col("id").alias("b")), "b", "left_semi")
    seen = reach(calls, changed_symbols(g, changed, file_pattern).select("node_id"), depth, most).where("distance > 0")
    rows = g.located().select(F.col("id").alias("node_id"), "name", "kind", F.col("file_path").alias("file")).join(seen.select("node_id", "distance", "confidence"), "node_id")
    return rows.orderBy("distance", F.desc("confidence"), "file", "name", "node_id").limit(most)


def change_summary(changed: DataFrame, symbols: DataFrame, impacted: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(changed, "changed_files").crossJoin(n(symbols, "changed_symbols")).crossJoin(impacted.agg(F.count(F.lit(1)).alias("impacted_symbols"), F.coalesce(F.max("distance"), F.lit(0)).alias("max_depth_reached")))


def _kinds(kinds: list[str] | None) -> Column:
    if kinds is None:
        return F.lit(True)
    if bad := [k for k in kinds if k not in EDGE_KINDS]:
        raise InvalidInput(f"unknown edge kinds: {bad}")
    return F.col("kind").isin(*kinds) if kinds else F.lit(False)


def subgraph(g: Graph, seeds: list[int], depth: int = 1, edge_kinds: list[str] | None = None, max_nodes: int = 200) -> dict[str, DataFrame]:
    """Nodes reached forwards from the seeds, and every allowed edge that leaves an expanded node. An empty list of kinds means no edges."""
    depth, most = clamp(depth, 1, 5, 1), clamp(max_nodes, 1, 1000, 200)
    allowed = g.edges.where(_kinds(edge_kinds))
    seen = reach(allowed.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "kind", "confidence"), one(g, *seeds), depth, most)
    top = seen.orderBy("distance", "node_id").limit(most).select("node_id", "distance")
    nodes = g.located().select(F.col("id").alias("node_id"), "kind", "name", "file_path").join(top, "node_id")
    out = allowed.join(top.where(F.col("distance") < depth).select(F.col("node_id").alias("src_id")), "src_id", "left_semi")
    out = out.join(top.select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi")
    return {"nodes": nodes, "edges": out.select("src_id", "dst_id", "kind", "confidence")}


def shortest_path(g: Graph, src: int, dst: int, max_depth: int = 10, max_paths: int = 1, relation_types: list[str] | None = None) -> DataFrame:
    """(path_no, step, node_id, kind, name, edge_kind, confidence): up to ``max_paths`` shortest paths, edges taken either way.

    Each further path avoids the inner nodes of those found. A node's path to
    itself has no steps. ``edge_kind`` is that of the edge to the next node.
    """
    schema = "path_no int, step int, node_id bigint, edge_kind string, confidence double"
    depth, paths = clamp(max_depth, 1, 20, 10), clamp(max_paths, 1, 5, 1)
    e = g.edges.where(_kinds(relation_types or None))
    both = e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "kind", "confidence").unionByName(e.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "kind", "confidence"))
    rows: list[tuple] = []
    blocked: set[int] = set()
    for no in range(1, paths + 1):
        if src == dst:
            break
        usable = both.where(~F.col("b").isin(*blocked)) if blocked else both
        found = _steps(g, usable, src, dst, depth)
        if not found:
            break
        rows += [(no, i, *step) for i, step in enumerate(found)]
        inner = {s[0] for s in found} - {src, dst}
        if not inner:
            break
        blocked |= inner
    out = g.spark.createDataFrame(rows, schema)
    names = g.nodes.select(F.col("id").alias("node_id"), "kind", "name")
    return names.join(F.broadcast(out), "node_id").select("path_no", "step", "node_id", "kind", "name", "edge_kind", "confidence")  # 5 paths of 21 nodes at most


def _steps(g: Graph, both: DataFrame, src: int, dst: int, depth: int) -> list[tuple[int, str | None, float | None]]:
    """Nodes of one shortest path with the edge to the next, or nothing; searched from both ends, the smaller frontier first."""
    ends = [[materialize(reach_start(g, n), "path")] for n in (src, dst)]
    sizes = [1, 1]
    for _ in range(depth):
        side = int(sizes[1] < sizes[0])
        mine, others = ends[side], ends[1 - side]
        new = materialize(_next_level(both, mine, len(mine)), "path")
        sizes[side] = new.count()
        if not sizes[side]:
            return []
        mine.append(new)
        # a meeting was not possible before this level, so only its nodes are looked for, nearest to the other end first
        for at in others:
            met = new.select("node_id").join(at.select("node_id"), "node_id", "left_semi").agg(F.min("node_id").alias("n")).first()["n"]
            if met is not None:
                return _joined(_trace(ends[0], met), _trace(ends[1], met))
    return []


def _joined(head: list[tuple], tail: list[tuple]) -> list[tuple]:
    """(node, edge kind, confidence to the next) from the traces of a meeting point to both ends."""
    back = list(reversed(head))
    nodes = [(node, *back[i + 1][1:3]) if i + 1 < len(back) else (node, None, None) for i, (node, *_) in enumerate(back)]
    for node, kind, confidence, via in tail:
        if via is not None:
            nodes[-1] = (nodes[-1][0], kind, confidence)
            nodes.append((via, None, None))
    return nodes


def reach_start(g: Graph, node: int) -> DataFrame:
    return g.spark.createDataFrame([(node, 0, None, None, None)], "node_id bigint, distance int, kind string, confidence double, via bigint")


def _trace(levels: list[DataFrame], node: int) -> list[tuple]:
    """(node, edge kind, confidence, node before) from a node to its start, in one query: each level's row is joined to the one before."""
    found = next(i for i in reversed(range(len(levels))) if not levels[i].where(F.col("node_id") == node).isEmpty())
    rows = levels[found].where(F.col("node_id") == node).select(F.array(F.struct("node_id", "kind", "confidence", "via")).alias("steps"), F.col("via").alias("at"))
    for level in reversed(levels[:found]):
        before = level.select(F.col("node_id").alias("at"), F.struct("node_id", "kind", "confidence", "via").alias("step"), F.col("via").alias("next"))
        rows = rows.join(before, "at").select(F.array_append("steps", F.col("step")).alias("steps"), F.col("next").alias("at"))
    return [tuple(s) for s in rows.first()["steps"]]


def file_deps(g: Graph, path: str) -> DataFrame:
    """(direction, path): files that a file includes, and those that include it."""
    f = g.nodes.where("node_type = 'file'").select("id", "name")
    me = f.where(F.col("name") == path).select(F.col("id").alias("me"))
    inc = g.edges.where("kind = 'includes'").select("src_id", "dst_id")
    out = inc.join(me, F.col("src_id") == F.col("me")).join(f, F.col("dst_id") == F.col("id")).select(F.lit("includes").alias("direction"), F.col("name").alias("path"))
    into = inc.join(me, F.col("dst_id") == F.col("me")).join(f, F.col("src_id") == F.col("id")).select(F.lit("included_by").alias("direction"), F.col("name").alias("path"))
    return out.unionByName(into).distinct()


def rank_in(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
