"""From a source tree to a graph, whole or incrementally."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph import __version__
from loomgraph.extract.udf import CRASHES, MAX_FILE_BYTES, SLOT_MS, extract
from loomgraph.graph import SCHEMA_VERSION, Graph, conform, empty_graph, kv_put, spread
from loomgraph.operators.maintain import detect, drop_files, force_clear, quarantine_add, quarantine_rehab, without_quarantined
from loomgraph.operators.resolve import resolve, stable_keys
from loomgraph.operators.text import index_lines
from loomgraph.schema import ROOT_STRIDE
from loomgraph.scratch import drop_table, materialize
from loomgraph.sources.scan import content_hash, git_branch, git_head, read_contents, scan


ID_BUCKETS = 1024


def dense_ids(rows: DataFrame, key: str, start: int = 0, count: int | None = None) -> DataFrame:
    """Rows with ``id``: start + 1, start + 2, ... in an order that a unique key fixes.

    Ranks are taken within hash buckets, in parallel, and shifted by the sizes
    of the buckets before; no task sees all rows. Where the count of rows is
    known, buckets are dealt to as many tasks as it asks for.
    """
    b = rows.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int"))
    before = b.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).drop("__n")
    ranked = (b if count is None else spread(b, "__b", rows=count)).withColumn("__nth", F.row_number().over(W.partitionBy("__b").orderBy(key)))
    return ranked.join(F.broadcast(before), "__b").withColumn("id", F.lit(start).cast("bigint") + F.col("__before") + F.col("__nth")).drop("__b", "__before", "__nth")  # one row a bucket


def tables_from(extracted: DataFrame, texts: DataFrame, g: Graph) -> dict[str, DataFrame]:
    """files, nodes, refs and edges of extractions (one row a file), with ids behind those of a graph's main root."""
    top = lambda df: df.where(F.col("id") < ROOT_STRIDE).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    files = dense_ids(texts.drop("text").join(extracted.select("path", "parse_status", "parse_error"), "path"), "path", top(g.files))
    of = files.select("path", F.col("id").alias("file_id"))
    each = stable_keys(extracted.select("path", F.posexplode("symbols").alias("ordinal", "s")).select("path", "ordinal", "s.*")).withColumn("node_type", F.lit("symbol"))
    key = F.concat("path", F.lit("::file"))
    own = files.select("path", F.lit("file").alias("node_type"), F.lit("file").alias("kind"), F.col("path").alias("name"), key.alias("stable_key"))
    nodes = dense_ids(each.unionByName(own, allowMissingColumns=True), "stable_key", top(g.nodes)).withColumn("is_definition", F.lit(1))
    nodes = nodes.join(of, "path").withColumn("file_id", F.when(F.col("node_type") == "symbol", F.col("file_id")))
    by = nodes.select(F.col("path").alias("p"), F.coalesce("ordinal", F.lit(-1)).alias("o"), F.col("id").alias("node"))
    r = extracted.select("path", F.posexplode("refs").alias("ordinal", "r")).select("path", "ordinal", "r.*").withColumn("__key", F.concat_ws("#", "path", F.col("ordinal").cast("string")))
    r = dense_ids(r, "__key", top(g.refs)).join(of, "path").join(by, (F.col("path") == F.col("p")) & (F.col("containing") == F.col("o")) & (F.col("containing") >= 0), "left")
    refs = r.withColumn("containing_node_id", F.col("node"))
    e = extracted.select("path", F.explode("edges").alias("e")).select("path", "e.*").where("confidence >= 0.3")
    src, dst = by.select(F.col("p").alias("sp"), F.col("o").alias("so"), F.col("node").alias("src_id")), by.select(F.col("p").alias("dp"), F.col("o").alias("do"), F.col("node").alias("dst_id"))
    e = e.join(src, (F.col("path") == F.col("sp")) & (F.col("src") == F.col("so"))).join(dst, (F.col("path") == F.col("dp")) & (F.col("dst") == F.col("do")))
    edges = e.withColumn("id", F.xxhash64("src_id", "dst_id", "kind", "evidence"))
    return {"files": conform(files, "files"), "nodes": conform(nodes, "nodes"), "refs": conform(refs, "refs"), "edges": conform(edges, "edges")}


def merge(g: Graph, new: dict[str, DataFrame], lines: DataFrame) -> Graph:
    """The graph with rows of (re)indexed files in place of what it had of them."""
    kept = drop_files(g, new["files"].select("path"))
    return kept.with_tables(**{t: getattr(kept, t).unionByName(new[t]) for t in ("files", "nodes", "refs", "edges")}, lines=kept.lines.unionByName(lines))


def index_texts(spark: SparkSession, texts: DataFrame, g: Graph | None = None, max_symbols: int = 50_000, max_bytes: int = MAX_FILE_BYTES, normalize_includes: bool = False, slot_ms: int = SLOT_MS) -> Graph:
    """A graph of (path, language, size_bytes, mtime_ns, content_hash, text[, read_error]) rows, added to one if given.

    A text with a read error is indexed as far as it goes, with status partial
    (failed, if it could not be read at all). Files that crash the extraction
    or exceed their time go to the quarantine.
    """
    g = g or empty_graph(spark)
    extracted = extract(texts, max_symbols, max_bytes, slot_ms)
    if "read_error" in texts.columns:
        faults = texts.select(F.col("path").alias("__path"), "read_error").where("read_error IS NOT NULL")
        status = F.when(F.startswith("read_error", F.lit("unreadable")), "failed").when(F.col("read_error").isNotNull() & (F.col("parse_status") == "ok"), "partial").otherwise(F.col("parse_status"))
        extracted = extracted.join(faults, F.col("path") == F.col("__path"), "left").withColumn("parse_status", status).withColumn("parse_error", F.coalesce("parse_error", "read_error")).drop("__path", "read_error")
    extracted = materialize(extracted, "extracted")  # parsed once, read by each table
    new = {t: materialize(df, t) for t, df in tables_from(extracted, texts.drop("read_error"), g).items()}
    merged = merge(g, new, spark.createDataFrame([], g.lines.schema))
    fresh = index_lines(merged.with_tables(files=new["files"]), texts.select("path", "text"))
    merged = merged.with_tables(lines=merged.lines.unionByName(fresh))
    crashed = extracted.where(F.regexp_extract("parse_error", "^[A-Za-z]+", 0).isin(*CRASHES)).select("path", F.col("parse_error").alias("error"), F.lit(now()).alias("at"))
    merged = merged.with_tables(quarantine=quarantine_add(merged.quarantine, crashed))
    merged = merged.with_tables(**{t: materialize(getattr(merged, t), t) for t in ("files", "nodes", "refs", "edges", "lines", "quarantine")})
    for done in (extracted, *new.values()):
        drop_table(done)
    out = resolve(merged, normalize_includes)
    return out.with_tables(refs=materialize(out.refs, "refs"), edges=materialize(out.edges, "edges"))


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def index(spark: SparkSession, root: str, g: Graph | None = None, force: bool = False, exclude: list[str] | None = None, no_gitignore: bool = False, max_files: int | None = None, **options) -> Graph:
    """Index a source tree: new and changed files are parsed, deleted ones leave, references are resolved again.

    Quarantined files that have changed since they were indexed get another
    try; others are passed over, and stay in the graph as they are.
    """
    g = g or empty_graph(spark)
    scanned = materialize(scan(spark, root, no_gitignore, exclude, max_files), "scanned")
    g = g.with_tables(quarantine=materialize(quarantine_rehab(g.quarantine, scanned, g.files), "quarantine"))
    work = without_quarantined(scanned, g.quarantine)
    other = detect(scanned, g.files, None, force).where("status IN ('new', 'changed')").select(F.col("path").alias("relative_path"))
    # only files of another size or time are read, and each once
    contents = materialize(read_contents(work.join(other, "relative_path", "left_semi").select(*scanned.columns)).withColumn("content_hash", content_hash("content")), "contents")
    hashes = contents.select(F.col("relative_path").alias("path"), "content_hash")
    status = materialize(detect(scanned, g.files, hashes, force), "status")
    if force:
        g = force_clear(g)
    g = drop_files(g, status.where("status = 'deleted'").select("path"))
    todo = status.where("status IN ('new', 'changed')").select("path")
    texts = contents.withColumnRenamed("relative_path", "path").join(todo, "path", "left_semi").select("path", "language", "size_bytes", "mtime_ns", "content_hash", "text", "read_error")
    out = index_texts(spark, texts, g, **options)
    meta = {"schema_version": str(SCHEMA_VERSION), "indexer_version": __version__, "repo_root": root, "last_index_time": now(), "git_head": git_head(root), "git_branch": git_branch(root)}
    drop_table(contents)
    drop_table(scanned)
    return out.with_tables(kv=kv_put(g.kv, meta))
