"""Text indexes and searches: symbol tokens, content lines, source ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions.globs import matches_glob
from loomgraph.functions.scalars import camel_split, fold_tokens
from loomgraph.graph import Graph, conform
from loomgraph.operators.paging import budget_prefix, first_groups
from loomgraph.plans.projection import byte_prefix, content_lines
from loomgraph.schema import InvalidInput, NotFound, clamp

PER_FILE = 20
#: Bytes of a file's text that the content index holds.
MOST_BYTES = 1 << 20


def node_tokens(g: Graph) -> DataFrame:
    """(node_id, field, pos, token) postings; names are split at camel case first."""
    fields = {"name": camel_split(F.col("name")), "qualname": F.col("qualname"), "signature": F.col("signature"), "doc": F.col("doc")}
    texts = F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(c, F.lit("")).alias("text")) for k, c in fields.items()])
    each = g.nodes.select(F.col("id").alias("node_id"), F.explode(texts).alias("x"))
    return each.select("node_id", "x.field", F.posexplode(fold_tokens(F.col("x.text"))).alias("pos", "token"))


def index_lines(g: Graph, contents: DataFrame, tracked: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Content lines of (path, text) rows whose file is not tracked (file_id) yet; skipped files have none, texts count up to ``most_bytes`` (0: whole)."""
    f = g.files.where("parse_status IS NULL OR parse_status <> 'skipped'").select(F.col("id").alias("file_id"), "path")
    if tracked is not None:
        f = f.join(tracked.select("file_id").distinct(), "file_id", "left_anti")
    text = F.when(F.octet_length("text") <= most_bytes, F.col("text")).otherwise(byte_prefix(F.col("text"), most_bytes)) if most_bytes else F.col("text")
    return conform(content_lines(contents.join(f, "path").select("file_id", text.alias("text"))), "lines")


def whole_line() -> Column:
    """The full line; of graphs stored before it was kept, the prefix."""
    return F.coalesce("full_line", "content")


def code_hits(g: Graph, query: str, file_pattern: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """(file_id, path, line_no, content, full_line) of lines that contain a string, wherever in the line."""
    if len(query) < 3:
        raise InvalidInput("a query has three characters at least")
    hit = F.contains(whole_line(), F.lit(query)) if case_sensitive else F.contains(F.lower(whole_line()), F.lit(query.lower()))
    f = g.files.select(F.col("id").alias("file_id"), "path")
    if file_pattern:
        f = f.where(matches_glob(F.col("path"), file_pattern) | (matches_glob(F.element_at(F.split("path", "/"), -1), file_pattern) if "/" not in file_pattern else F.lit(False)))
    return g.lines.where(hit).join(f, "file_id")


def match_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("match_count"))


def code_search(g: Graph, query: str, file_pattern: str | None = None, limit: int = 50, context_lines: int = 0, max_bytes: int = 0, case_sensitive: bool = False) -> DataFrame:
    """(file, line, text, match_count) of the first files with hits, 20 lines of each at most, with lines around them if asked."""
    limit, context_lines = clamp(limit, 1, 500, 50), clamp(context_lines, 0, 5, 0)
    hits = code_hits(g, query, file_pattern, case_sensitive).withColumn("match_count", F.count(F.lit(1)).over(W.partitionBy("file_id")))
    rows = first_groups(hits, "file_id", [F.col("line_no")], limit, PER_FILE)
    rows = rows.select(F.col("path").alias("file"), "file_id", F.col("line_no").alias("line"), whole_line().alias("text"), "match_count")
    if context_lines:
        near = g.lines.select(F.col("file_id").alias("cf"), F.col("line_no").alias("cl"), whole_line().alias("ct"))
        around = rows.join(near, (F.col("file_id") == F.col("cf")) & F.col("cl").between(F.col("line") - context_lines, F.col("line") + context_lines))
        block = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cl", "ct"))), lambda x: F.concat(x["cl"].cast("string"), F.lit(": "), x["ct"])), "\n")
        rows = around.groupBy("file", "file_id", "line", "match_count").agg(block.alias("text")).select("file", "file_id", "line", "text", "match_count")
    cost = (F.octet_length("text") + 24).cast("bigint")
    return budget_prefix(rows, [F.col("file_id"), F.col("line")], cost, max_bytes, limit=limit * PER_FILE).drop("file_id")


def source_range(texts: DataFrame, start: int, end: int) -> DataFrame:
    """(path, source): lines start to end, from 1 and inclusive, each ended by a line feed."""
    lines = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    part = F.slice(lines, F.lit(start), F.lit(end - start + 1))
    return texts.select("path", F.array_join(F.transform(part, lambda x: F.concat(x, F.lit("\n"))), "").alias("source"))


def source_at(texts: DataFrame, path: str, start_line: int, end_line: int) -> DataFrame:
    if start_line < 1 or end_line < start_line:
        raise InvalidInput("lines run from 1 and the end is not before the start")
    if end_line - start_line > 500:
        raise InvalidInput("500 lines at most")
    rows = source_range(texts.where(F.col("path") == path), start_line, end_line).where("source <> ''")
    if rows.isEmpty():
        raise NotFound(f"no such lines: {path}:{start_line}-{end_line}")
    return rows.select("path", F.lit(start_line).alias("start_line"), F.lit(end_line).alias("end_line"), "source")


def truncated(text: Column, n: int) -> Column:
    """The first lines of a text and a mark if there were more; 0 is no cap."""
    if n <= 0:
        return text
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n...(truncated)"))).otherwise(text)
