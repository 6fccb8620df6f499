"""A symbol with its surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.globs import matches_glob
from loomgraph.graph import Graph
from loomgraph.operators.calls import callees, callers, callsite_candidates
from loomgraph.operators.listing import resolve_node
from loomgraph.operators.text import source_range, truncated
from loomgraph.schema import InvalidInput, clamp


def symbol_get(g: Graph, ids: list[int], sources: DataFrame | None = None, most_lines: int = 0) -> DataFrame:
    """Symbols in the order of ``ids``, missing ones left out; with their source from (path, text) rows if given."""
    if len(ids) > 50:
        raise InvalidInput("50 ids at most")
    wanted = g.spark.createDataFrame(list(enumerate(ids)), "pos int, id bigint")
    rows = g.located().join(F.broadcast(wanted), "id")  # 50 rows at most
    rows = rows.select("pos", F.col("id").alias("node_id"), "kind", "name", "qualname", "signature", "file_path", "start_line", "end_line", "doc")
    if sources is None:
        return rows
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    part = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    joined = rows.join(sources.select(F.col("path").alias("file_path"), "text"), "file_path", "left")
    return joined.withColumn("source", F.when(F.col("start_line").isNotNull(), truncated(part, most_lines))).drop("text")


def siblings(g: Graph, node_id: int, most: int = 30) -> DataFrame:
    """The container of a node and its other members by line."""
    up = g.edges.where((F.col("kind") == "contains") & (F.col("dst_id") == node_id)).orderBy("src_id").limit(1).select("src_id")
    ids = g.edges.where(F.col("kind") == "contains").join(F.broadcast(up), "src_id").where(F.col("dst_id") != node_id).select(F.col("dst_id").alias("id"))
    return g.nodes.join(ids, "id", "left_semi").orderBy("start_line", "id").limit(most).select(F.col("id").alias("node_id"), "kind", "name", "start_line")


def container(g: Graph, node_id: int) -> DataFrame:
    up = g.edges.where((F.col("kind") == "contains") & (F.col("dst_id") == node_id)).orderBy("src_id").limit(1).select(F.col("src_id").alias("id"))
    return g.located().join(F.broadcast(up), "id").select(F.col("id").alias("node_id"), "kind", "name", "file_path")


def base_types(g: Graph, node_id: int) -> DataFrame:
    """What the container of a node inherits from."""
    up = container(g, node_id).select(F.col("node_id").alias("src_id"))
    to = g.edges.where("kind = 'inherits'").join(F.broadcast(up), "src_id").select(F.col("dst_id").alias("id"))
    return g.located().join(to, "id", "left_semi").select(F.col("id").alias("node_id"), "kind", "name", "file_path")


def context_for(g: Graph, node_id: int | None = None, symbol: str | None = None, file: str | None = None, sources: DataFrame | None = None, max_callers: int = 10, max_callees: int = 10, max_source_lines: int = 0) -> dict[str, DataFrame]:
    """A symbol, its callers (or candidates, if it has none), callees, container, siblings and base types."""
    node_id = resolve_node(g, node_id, symbol, file)
    n_in, n_out = clamp(max_callers, 0, 100, 10), clamp(max_callees, 0, 100, 10)
    out = {
        "symbol": symbol_get(g, [node_id], sources, max_source_lines).drop("pos"),
        "callers": callers(g, node_id).orderBy(F.desc("confidence"), "caller_node_id").limit(n_in),
        "callees": callees(g, node_id).orderBy(F.desc("confidence"), "callee_node_id").limit(n_out),
        "container": container(g, node_id), "siblings": siblings(g, node_id), "base_types": base_types(g, node_id),
    }
    if callers(g, node_id).isEmpty():
        out["candidate_callers"] = callsite_candidates(g, node_id, n_in)
    return out


def symbols_named(g: Graph, name: str, file_pattern: str | None = None, most: int = 25) -> DataFrame:
    """Symbols of a name, or else of names that begin with it; shortest names first."""
    rows = g.located().where("node_type = 'symbol'")
    if file_pattern:
        rows = rows.where(matches_glob(F.col("file_path"), file_pattern))
    found = rows.where(F.col("name") == name)
    if found.isEmpty():
        found = rows.where(F.col("name").startswith(name))
    order = [F.length("name"), F.length("qualname"), F.col("file_path"), F.col("start_line"), F.col("id")]
    return found.orderBy(*order).limit(most).select(F.col("id").alias("node_id"), "name", "qualname", "kind", "file_path", "start_line")


def context_by_name(g: Graph, name: str, file_pattern: str | None = None, **options) -> dict[str, DataFrame]:
    """The context of the only symbol of a name, or the candidates."""
    found = symbols_named(g, name, file_pattern)
    ids = [r["node_id"] for r in found.select("node_id").limit(2).collect()]
    return context_for(g, ids[0], **options) if len(ids) == 1 else {"candidates": found}


__all__ = ["context_for", "context_by_name", "symbol_get", "siblings", "container", "base_types", "symbols_named", "source_range"]
