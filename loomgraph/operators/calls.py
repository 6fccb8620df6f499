"""Callers, callees, references, and scored candidates for call sites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.functions.scalars import (
    clean_receiver, ends_in_part, is_common_member, module_of, owner_of, pattern_bonus, plain_type, receiver_of, receiver_passes, receiver_strength, same_name,
)
from loomgraph.functions.signatures import call_signature
from loomgraph.graph import Graph
from loomgraph.operators.paging import budget_prefix, page, top_k
from loomgraph.schema import NotFound, clamp
from loomgraph.scratch import materialize

TYPE_KINDS = ("class", "struct", "interface", "type", "trait", "type_alias", "enum", "constructor_fn")
LOCAL_CAP, INCLUDED_CAP, GLOBAL_CAP = 8, 12, 16


def callers(g: Graph, node_id: int, min_confidence: float = 0.0) -> DataFrame:
    """Inbound call edges with their callers."""
    e = g.edges.where((F.col("dst_id") == node_id) & (F.col("kind") == "calls") & (F.col("confidence") >= clamp(min_confidence, 0.0, 1.0, 0.0)))
    n = g.located().withColumnRenamed("id", "caller_node_id")
    return e.join(n, F.col("src_id") == F.col("caller_node_id")).select("caller_node_id", F.col("name").alias("caller_name"), "file_path", "start_line", "node_type", "confidence")


def callees(g: Graph, node_id: int) -> DataFrame:
    e = g.edges.where((F.col("src_id") == node_id) & (F.col("kind") == "calls"))
    n = g.located().withColumnRenamed("id", "callee_node_id")
    return e.join(n, F.col("dst_id") == F.col("callee_node_id")).select("callee_node_id", F.col("name").alias("callee_name"), "qualname", "signature", "file_path", "confidence")


def callers_page(g: Graph, node_id: int, limit: int = 50, min_confidence: float = 0.0) -> DataFrame:
    return page(callers(g, node_id, min_confidence), [F.desc("confidence"), F.col("caller_node_id")], clamp(limit, 1, 500, 50)).drop("node_type", "start_line")


def callees_page(g: Graph, node_id: int, limit: int = 50) -> DataFrame:
    return page(callees(g, node_id), [F.desc("confidence"), F.col("callee_node_id")], clamp(limit, 1, 500, 50))


def grouped(rows: DataFrame, by: str, name: str = "caller_name") -> DataFrame:
    """(group, n, names) of listed rows by file, module or symbol."""
    key = {"file": F.coalesce("file_path", F.lit("")), "module": module_of(F.coalesce("file_path", F.lit(""))), "symbol": F.col(name)}[by]
    return rows.groupBy(key.alias("group")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))


def references(g: Graph, node_id: int, limit: int = 50) -> DataFrame:
    """References that were resolved to a node."""
    r = g.refs.where(F.col("resolved_node_id") == node_id).join(g.files.select(F.col("id").alias("fid"), "path"), F.col("file_id") == F.col("fid"), "left")
    return page(r, [F.col("path"), F.col("start_line"), F.col("start_col"), F.col("id"), F.col("name")], clamp(limit, 1, 500, 50)).select(F.col("id").alias("ref_id"), "kind", "name", F.col("path").alias("file_path"), "start_line", "start_col")


@dataclass(frozen=True)
class Target:
    """What is known of the symbol whose call sites are sought."""

    id: int
    name: str
    qualname: str
    owner: str
    owner_qualname: str
    least_args: int | None
    most_args: int | None
    arg_pattern: str | None


def target_of(g: Graph, node_id: int) -> Target:
    """Name, owner and parameters of a node: the owner by a contains edge from a symbol, else by its qualified name, else by the tightest enclosing symbol."""
    me = g.nodes.where(F.col("id") == node_id).first()
    if not me:
        raise NotFound(f"no node {node_id}")
    holders = g.edges.where((F.col("dst_id") == node_id) & (F.col("kind") == "contains")).join(g.nodes.where("node_type = 'symbol' AND kind <> 'namespace'").select(F.col("id").alias("oid"), F.col("name").alias("oname"), F.col("qualname").alias("oqual")), F.col("src_id") == F.col("oid"))
    row = holders.orderBy("oid").select("oname", "oqual").first()
    owner, owner_qual = (row["oname"], row["oqual"] or row["oname"]) if row else ("", "")
    if not owner and me["qualname"] and me["qualname"] != me["name"]:
        cut = max(me["qualname"].rfind(s) for s in ("::", ".", "#", "/"))
        owner_qual = me["qualname"][:cut] if cut > 0 else ""
        owner = max(((owner_qual.rfind(s), owner_qual[owner_qual.rfind(s) + len(s) :]) for s in ("::", ".", "#", "/") if s in owner_qual), default=(0, owner_qual))[1]
    if not owner and me["file_id"] is not None and me["start_line"] is not None:
        row = enclosing(g.nodes.where(F.col("kind").isin(*TYPE_KINDS)), me["file_id"], me["start_line"], me["end_line"] or me["start_line"]).where(F.col("id") != node_id).orderBy("span", "id").first()
        owner, owner_qual = (row["name"], row["qualname"] or row["name"]) if row else ("", "")
    found = call_signature(me["signature"], me["name"])
    return Target(node_id, me["name"], me["qualname"] or me["name"], owner, owner_qual, *(found or (None, None, None)))


def enclosing(nodes: DataFrame, file_id: int, start: int, end: int) -> DataFrame:
    """Symbols of a file whose lines contain a range, with their length."""
    rows = nodes.where((F.col("file_id") == file_id) & (F.col("start_line") <= start) & (F.col("end_line") >= end) & ~((F.col("start_line") == start) & (F.col("end_line") == end)))
    return rows.withColumn("span", F.col("end_line") - F.col("start_line"))


def matching_refs(g: Graph, name: str) -> DataFrame:
    """Call references whose text is a name or ends in it behind a separator."""
    low, n = F.lower("name"), name.lower()
    hit = (low == n) | low.endswith("." + n) | low.endswith("::" + n) | low.endswith("->" + n)
    return g.refs.where((F.col("kind") == "call") & hit)


def _sites(g: Graph, t: Target, query_limit: int) -> DataFrame:
    """Call sites in order, capped, with their file and containing symbol; repeated sites once."""
    r = matching_refs(g, t.name).join(g.files.select(F.col("id").alias("fid"), "path", "language"), F.col("file_id") == F.col("fid"), "left")
    holder = g.nodes.select(F.col("id").alias("hid"), F.col("name").alias("caller_name"), F.col("qualname").alias("caller_qualname"))
    r = r.orderBy("path", "start_line", "start_col", "name", "containing_node_id").limit(query_limit).join(holder, F.col("containing_node_id") == F.col("hid"), "left").drop("hid", "fid")
    once = W.partitionBy("path", "start_line", "start_col", "name").orderBy("id", "containing_node_id")
    return r.withColumn("__nth", F.row_number().over(once)).where("__nth = 1").drop("__nth").withColumn("receiver_hint", F.coalesce(clean_receiver(receiver_of(F.col("name"), F.lit(t.name))), F.lit("")))


def included_files(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(from_file, to_file): ids of files, all or those of ``sources`` (file_id), and of those that they include."""
    f, n = g.files.select(F.col("id").alias("file"), "path"), g.nodes.where("node_type = 'file'").select("id", F.col("name").alias("path"))
    of = f if sources is None else f.join(sources.select(F.col("file_id").alias("file")).distinct(), "file", "left_semi")
    src, dst = n.join(of, "path").select(F.col("id").alias("src_id"), F.col("file").alias("from_file")), n.join(f, "path").select(F.col("id").alias("dst_id"), F.col("file").alias("to_file"))
    inc = g.edges.where("kind = 'includes'").select("src_id", "dst_id")
    inc = inc.join(src, "src_id").join(dst, "dst_id")
    return inc.select("from_file", "to_file").distinct()


def resolved_types(g: Graph, sites: DataFrame) -> DataFrame:
    """Sites with the type that their hint names: in the same file, in files it includes, or anywhere if it is the only one."""
    hinted = sites.withColumn("__hint", plain_type(F.coalesce("receiver_type_hint", F.lit(""))))
    wanted = hinted.where("__hint <> ''").select("file_id", "__hint").distinct()
    types = g.nodes.where(F.col("kind").isin(*TYPE_KINDS) & F.col("file_id").isNotNull()).select(F.col("id").alias("tid"), F.col("file_id").alias("tfile"), F.col("name").alias("tname"), F.coalesce("qualname", "name").alias("tqual"))
    last = F.lower(F.regexp_extract("__hint", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1))
    pairs = wanted.withColumn("__last", last).join(types, F.lower("tname") == F.col("__last"))
    quality = F.when(same_name(F.col("tqual"), F.col("__hint")) | same_name(F.col("tname"), F.col("__hint")), 3).when(ends_in_part(F.col("tqual"), F.col("__hint")) | ends_in_part(F.col("__hint"), F.col("tqual")), 2).otherwise(1)
    inc = included_files(g, wanted)
    scoped = pairs.join(inc, (F.col("file_id") == F.col("from_file")) & (F.col("tfile") == F.col("to_file")), "left")
    scope = F.when(F.col("tfile") == F.col("file_id"), 0).when(F.col("to_file").isNotNull(), 1).otherwise(2)
    ranked = scoped.withColumn("scope", scope).withColumn("quality", quality)
    nth = F.row_number().over(W.partitionBy("file_id", "__hint", "scope").orderBy(F.desc("quality"), "tid"))
    ranked = ranked.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("scope") == 0, LOCAL_CAP).when(F.col("scope") == 1, INCLUDED_CAP).otherwise(GLOBAL_CAP))
    site = W.partitionBy("file_id", "__hint")
    ranked = ranked.withColumn("least", F.min("scope").over(site)).where("scope = least").withColumn("top", F.max("quality").over(site))
    best = ranked.groupBy("file_id", "__hint").agg(
        F.first("scope").alias("scope"), F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == F.col("top")).cast("int")).alias("n_top"), F.min(F.when(F.col("quality") == F.col("top"), F.struct("tid", "tname", "tqual"))).alias("best"),
    )
    vague = (F.col("n_top") > 1) | ((F.col("scope") == 2) & (F.col("n") > 1))
    best = best.select(
        F.col("file_id").alias("__f"), F.col("__hint").alias("__h"), vague.alias("receiver_type_ambiguous"), F.when(~vague, F.col("best.tname")).alias("resolved_receiver_type"), F.when(~vague, F.col("best.tqual")).alias("__resolved_qual"),
        F.when(F.col("scope") == 0, "same_file").when(F.col("scope") == 1, "included").otherwise("global").alias("receiver_type_resolution_source"),
    )
    out = hinted.join(best, (F.col("file_id") == F.col("__f")) & (F.col("__hint") == F.col("__h")), "left").drop("__f", "__h")
    return out.withColumn("receiver_type_ambiguous", F.coalesce("receiver_type_ambiguous", F.lit(False)))


def score_sites(sites: DataFrame, t: Target) -> DataFrame:
    """Confidence and heuristic of each site by receiver, type and arity; sites with too few or many arguments go."""
    owner, owner_qual = F.lit(t.owner), F.lit(t.owner_qualname)
    text = receiver_strength(F.col("receiver_hint"), owner, owner_qual)
    by_type = F.greatest(receiver_strength(F.coalesce("resolved_receiver_type", F.lit("")), owner, owner_qual), F.when(F.col("receiver_type_ambiguous"), 0).otherwise(receiver_strength(F.col("__hint"), owner, owner_qual)))
    far = F.coalesce(F.col("receiver_type_resolution_source").isin("included", "global"), F.lit(False)) & F.col("resolved_receiver_type").isNotNull()
    inside = same_name(owner_of(F.coalesce("caller_qualname", F.lit(""))), owner_qual) | ends_in_part(owner_qual, owner_of(F.coalesce("caller_qualname", F.lit("")))) | same_name(F.coalesce("caller_name", F.lit("")), owner)
    own = (F.col("receiver_hint") == "this") & (owner != "") & F.coalesce(inside, F.lit(False))
    cases = [
        (text == 3, 0.90, "receiver_exact_target_owner"), (text == 2, 0.82, "receiver_suffix_target_owner"), (text == 1, 0.72, "receiver_bare_target_owner"),
        (far & (by_type == 3), 0.93, "cross_file_receiver_type_exact"), (far & (by_type > 0), 0.86, "cross_file_receiver_type_suffix"),
        (by_type == 3, 0.89, "local_receiver_type_exact_target_owner"), (by_type > 0, 0.81, "local_receiver_type_matches_target_owner"),
        (own, 0.68, "this_receiver_in_target_owner"), (F.col("receiver_hint") != "", 0.40, "unrelated_member_suffix_match"),
    ]
    score, why = F.lit(0.35), F.lit("bare_name_match")
    for case, value, label in reversed(cases):
        score, why = F.when(case, value).otherwise(score), F.when(case, label).otherwise(why)
    matched = (text > 0) | (by_type > 0) | own
    score = F.when(is_common_member(F.lit(t.name)) & ~matched, F.greatest(F.lit(0.2), score - 0.10)).otherwise(score)
    out = sites.withColumn("confidence", score).withColumn("heuristic", why)
    if t.most_args is None:
        return out
    known = F.col("arg_count").isNotNull()
    fits = known & F.col("arg_count").between(t.least_args, t.most_args)
    bonus = F.when(F.coalesce(F.col("arg_pattern"), F.lit("")) != "", pattern_bonus(F.col("arg_pattern"), F.lit(t.arg_pattern or ""))).otherwise(0.0)
    out = out.where(~known | fits)
    out = out.withColumn("__bonus", F.when(fits, bonus).otherwise(0.0))
    out = out.withColumn("confidence", F.when(fits, F.least(F.lit(0.99), F.col("confidence") + 0.06 + F.col("__bonus"))).otherwise(F.col("confidence")))
    return out.withColumn("heuristic", F.concat("heuristic", F.when(fits, "+arity_match").otherwise(""), F.when(F.col("__bonus") > 0, "+arg_pattern").otherwise(""))).drop("__bonus")


CANDIDATE = ("caller_name", "path", "start_line", "start_col", "name", "receiver_hint", "receiver_type_hint", "resolved_receiver_type", "receiver_type_ambiguous", "arg_count", "confidence", "heuristic")


def _order() -> list[Column]:
    return [F.desc("confidence"), F.col("path"), F.col("start_line"), F.col("start_col"), F.col("name")]


def callsite_scores(g: Graph, node_id: int, limit: int = 20, receiver: str | None = None) -> DataFrame:
    """All scored candidate sites of a target, unordered: textual matches (capped), deduplicated, typed, scored, filtered by receiver."""
    limit = min(limit, 500)
    t = target_of(g, node_id)
    cap = 5000 if receiver else min(5000, max(4 * limit, limit, 200))
    sites = materialize(_sites(g, t, cap if limit > 0 else 0), "sites")  # found once, though their hints are looked up apart
    scored = score_sites(resolved_types(g, sites), t)
    if receiver:
        scored = scored.where(receiver_passes(F.col("receiver_hint"), F.coalesce("resolved_receiver_type", "receiver_type_hint", F.lit("")), receiver))
    return scored


def callsite_candidates(g: Graph, node_id: int, limit: int = 20, receiver: str | None = None, max_bytes: int = 16_000) -> DataFrame:
    """The best candidate sites within the byte budget."""
    cost = (F.lit(160) + F.octet_length("name") + F.octet_length(F.coalesce("path", F.lit(""))) + F.octet_length(F.coalesce("caller_name", F.lit("")))).cast("bigint")
    rows = budget_prefix(callsite_scores(g, node_id, limit, receiver), _order(), cost, max_bytes, base=256, limit=max(0, min(limit, 500)))
    return rows.select(*CANDIDATE).withColumnRenamed("path", "file_path").withColumnRenamed("name", "callee_text")


def candidate_buckets(scored: DataFrame) -> dict[str, DataFrame]:
    """Counts of candidates by arity (with its top three files), heuristic (top eight) and file (top eight)."""
    by = lambda c: scored.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    per = scored.groupBy(F.coalesce(F.col("arg_count").cast("string"), F.lit("unknown")).alias("arity"), "path").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(W.partitionBy("arity").orderBy(F.desc("n"), "path"))
    return {"arity": by("arg_count"), "arity_files": per.withColumn("nth", nth).where("nth <= 3"), "heuristic": top_k(by("heuristic"), "n", "value", 8), "file": top_k(by("path"), "n", "value", 8)}


def candidate_meta(g: Graph, node_id: int, scored: DataFrame, returned: int) -> DataFrame:
    """(candidate_total, scored, filtered_hidden): the total counts every textual match, past the cap too."""
    t = target_of(g, node_id)
    total = matching_refs(g, t.name).agg(F.count(F.lit(1)).alias("candidate_total"))
    return total.crossJoin(scored.agg(F.count(F.lit(1)).alias("scored"))).withColumn("filtered_hidden", F.col("candidate_total") - returned)


def callers_approx(g: Graph, node_id: int, limit: int = 50, min_confidence: float = 0.0, mode: str = "exact_then_candidates", receiver: str | None = None, max_bytes: int = 16_000) -> dict[str, DataFrame]:
    """Exact callers, and candidates: never, if no symbol calls the target (the default), or always."""
    exact = callers_page(g, node_id, limit, min_confidence)
    out = {"results": exact}
    if mode == "exact_plus_candidates" or (mode == "exact_then_candidates" and callers(g, node_id, min_confidence).where("node_type <> 'file'").isEmpty()):
        out["candidate_results"] = callsite_candidates(g, node_id, limit, receiver, max_bytes)
    return out


def callers_lean(g: Graph, node_id: int, top_n: int = 10, min_confidence: float = 0.0, max_bytes: int = 4096) -> DataFrame:
    """(file, line, caller, confidence) of the best callers within the byte budget."""
    rows = callers(g, node_id, min_confidence)
    order = [F.desc("confidence"), F.col("caller_node_id")]
    cost = (F.lit(48) + F.octet_length(F.coalesce("file_path", F.lit(""))) + F.octet_length("caller_name")).cast("bigint")
    return budget_prefix(rows, order, cost, max_bytes, base=256, limit=clamp(top_n, 1, 100, 10)).select(F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("caller_name").alias("caller"), "confidence")
