"""Scores of answers and of tool use."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CITATION = r"([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]+):(\d+)(?:-(\d+))?"
STRUCTURAL_TOOLS = ("symbol_search", "symbol_get", "symbol_list", "callers_approx", "callees_approx", "references", "context_for", "impact_of", "subgraph", "shortest_path", "file_deps", "find_implementations", "file_overview", "file_summary")
READ_TOOLS = ("source_at", "read_file", "Read")


def citations(answers: DataFrame) -> DataFrame:
    """(id, file, start_line, end_line) cited as ``file:start-end`` in answers (id, text), each once.

    Only the last final-answer block counts if there is one.
    """
    block = F.regexp_extract("text", r"(?s).*<final_answer>(.*?)</final_answer>", 1)
    text = F.when(block != "", block).otherwise(F.col("text"))
    each = answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))).alias("c"))
    part = lambda i: F.regexp_extract("c", CITATION, i)
    start = part(2).cast("int")
    end = F.when(part(3) != "", part(3).cast("int")).otherwise(start)
    return each.select("id", F.regexp_replace(part(1), r"\\", "/").alias("file"), F.least(start, end).alias("start_line"), F.greatest(start, end).alias("end_line")).distinct()


def canonical_paths(cited: DataFrame, truth_files: DataFrame, root: str = "") -> DataFrame:
    """Cited files by the path that the truth (id, file) knows: itself, below the root, or by its only suffix match."""
    bare = F.regexp_replace(F.when(F.startswith("file", F.lit(root.rstrip("/") + "/")), F.substring(F.col("file"), F.lit(len(root.rstrip("/")) + 2), F.length("file"))).otherwise(F.col("file")) if root else F.col("file"), r"^\./", "")
    c = cited.withColumn("file", bare)
    t = truth_files.select(F.col("id").alias("tid"), F.col("file").alias("tfile")).distinct()
    pairs = c.select("id", "file").distinct().join(t, (F.col("id") == F.col("tid")) & F.endswith(F.col("tfile"), F.concat(F.lit("/"), F.col("file"))))
    only = pairs.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n"), F.min("tfile").alias("as")).where("n = 1").drop("n")
    return c.join(only, ["id", "file"], "left").withColumn("file", F.coalesce("as", "file")).drop("as").distinct()


def lines_of(ranges: DataFrame) -> DataFrame:
    """(id, file, line), distinct, of ranges."""
    return ranges.select("id", "file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def _prf(hits: Column, found: Column, wanted: Column) -> list[Column]:
    p = F.when(found > 0, hits / found).otherwise(F.when(wanted == 0, 1.0).otherwise(0.0))
    r = F.when(wanted > 0, hits / wanted).otherwise(1.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def set_scores(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(id, hits, found, wanted, precision, recall, f1) of two sets of keys by id."""
    f = found.select("id", *keys).distinct().withColumn("in_found", F.lit(1))
    w = wanted.select("id", *keys).distinct().withColumn("in_wanted", F.lit(1))
    both = f.join(w, ["id", *keys], "full").fillna(0, ["in_found", "in_wanted"])
    sums = both.groupBy("id").agg(F.sum(F.col("in_found") * F.col("in_wanted")).alias("hits"), F.sum("in_found").alias("found"), F.sum("in_wanted").alias("wanted"))
    return sums.select("id", "hits", "found", "wanted", *_prf(F.col("hits"), F.col("found"), F.col("wanted")))


def file_scores(cited: DataFrame, truth: DataFrame) -> DataFrame:
    return set_scores(cited, truth, ["file"])


def line_scores(cited: DataFrame, truth: DataFrame) -> DataFrame:
    return set_scores(lines_of(cited), lines_of(truth), ["file", "line"])


def range_coverage(cited: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, file, start_line, end_line, coverage) of each true range."""
    lines = truth.select("id", "file", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    got = lines_of(cited).withColumn("hit", F.lit(1))
    return lines.join(got, ["id", "file", "line"], "left").groupBy("id", "file", "start_line", "end_line").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage"))


def missing_and_extra(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, file, side): truth that was not cited, and citations that are not true."""
    f, w = found.select("id", "file").distinct(), wanted.select("id", "file").distinct()
    return w.subtract(f).withColumn("side", F.lit("missing")).unionByName(f.subtract(w).withColumn("side", F.lit("extra")))


def tool_metrics(calls: DataFrame) -> DataFrame:
    """(id, calls, structural, structural_ratio, result_bytes) of calls (id, n, tool, result)."""
    s = F.col("tool").isin(*STRUCTURAL_TOOLS)
    out = calls.groupBy("id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(s, 1).otherwise(0)).alias("structural"), F.sum(F.coalesce(F.octet_length("result"), F.lit(0))).alias("result_bytes"))
    return out.withColumn("structural_ratio", F.col("structural") / F.col("calls"))


def tool_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("id", "tool").agg(F.count(F.lit(1)).alias("n"))


def rereads(reads: DataFrame) -> DataFrame:
    """(id, reads, rereads, reread_rate) of reads (id, n, file, start_line, end_line): a reread overlaps an earlier read of the file."""
    a, b = reads.alias("a"), reads.alias("b")
    again = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.file") == F.col("b.file")) & (F.col("b.n") < F.col("a.n")) & (F.col("b.start_line") <= F.col("a.end_line")) & (F.col("b.end_line") >= F.col("a.start_line")), "left_semi")
    total = reads.groupBy("id").agg(F.count(F.lit(1)).alias("reads"))
    out = total.join(again.groupBy("id").agg(F.count(F.lit(1)).alias("rereads")), "id", "left").fillna(0, ["rereads"])
    return out.withColumn("reread_rate", F.col("rereads") / F.col("reads"))


def node_reuse(calls: DataFrame) -> DataFrame:
    """(id, uses, reused): node ids passed to calls (id, n, node_id) and how many had been passed before."""
    nth = F.row_number().over(W.partitionBy("id", "node_id").orderBy("n"))
    used = calls.where("node_id IS NOT NULL").withColumn("nth", nth)
    return used.groupBy("id").agg(F.count(F.lit(1)).alias("uses"), F.sum((F.col("nth") > 1).cast("int")).alias("reused"))


def candidate_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"))


def normalize_calls(payload: str | dict | list) -> list[dict]:
    """Tool calls of a trajectory, whatever its keys: [{n, tool, arguments, result}]."""
    data = json.loads(payload) if isinstance(payload, str) else payload
    if isinstance(data, dict):
        data = next((data[k] for k in ("tool_calls", "calls", "steps", "events") if isinstance(data.get(k), list)), [])
    pick = lambda c, *keys: next((c[k] for k in keys if k in c), None)
    out = []
    for c in data:
        if isinstance(c, dict) and (name := pick(c, "tool", "name", "tool_name")):
            args = pick(c, "arguments", "args", "input", "params") or {}
            out.append({"n": len(out), "tool": name, "arguments": json.loads(args) if isinstance(args, str) else args, "result": pick(c, "result", "output", "response")})
    return out


def status(payload: dict, expected: dict, golden: dict | None = None) -> tuple[str, list[str]]:
    """PASS, WARN or FAIL: bounds ``min_x``, ``max_x`` and values ``x`` on a payload; a golden difference only warns."""
    bad = []
    for key, want in expected.items():
        low, high = key.startswith("min_"), key.startswith("max_")
        have = payload.get(key[4:] if low or high else key)
        ok = have is not None and (have >= want if low else have <= want if high else have == want)
        if not ok:
            bad.append(f"{key}: {have!r} against {want!r}")
    if bad:
        return "FAIL", bad
    return ("WARN", ["differs from the golden result"]) if golden is not None and golden != payload else ("PASS", [])
