"""Mixing sources to target token shares by weighted sampling without replacement.

Each document gets an exponential key ``-ln(u) / weight`` (u from a hash of
its id, weight from its quality label): taking keys in ascending order is
Efraimidis-Spirakis sampling. Each source has a token budget, its share of the
total. While the budget exceeds what the source holds, complete epochs are
taken; what remains is filled by the longest prefix, in key order, whose
tokens fit.

A sort of a whole source would put the hot source in one task. Keys are
radix-partitioned instead, by their logarithm, so that a bucket holds less
than 1/10,000 of a source whatever the weights: tokens are summed by (source,
bucket), the prefix sum over these sums finds the one bucket of each source in
which the budget ends, and only that bucket's rows are sorted and summed one
by one. The result is that of the full sort.

Rows are numbered and their tokens counted once, in a table in the shared
folder; decisions are made over its slim columns and meet the texts by row
number, which no source or repeated document can make uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.llm.columns import all_of, unused, with_row_ids
from loomgraph.scratch import materialize

#: Key buckets for each step of e in the key.
BUCKETS = 6_000
NO_BUCKET = 1 << 30
WEIGHTS = {1: 1.0, 0: 0.25, None: 0.5}
SEED = "mix-1"
NO_SOURCE = ""
#: Sources up to which their budgets are sent to every task; more meet the rows in a shuffle join.
MOST_BROADCAST = 100_000
#: Copies of a row that one task makes at once.
RUN = 4096


def n_tokens(text: str = "text") -> Column:
    """White-space separated tokens; 0 for null or blank text."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \t\r\n]+"))).cast("bigint")


def exponential_key(weight: Column, key: str = "doc_id", seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of seed and id."""
    h = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _decide(rows: DataFrame, labels: DataFrame, shares: dict[str, float] | None, total_tokens: int | None) -> DataFrame:
    """(row, doc_id, source, tokens, weight, epochs, taken) of rows (row, doc_id, source, tokens)."""
    quality = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("quality")).groupBy("label_id").agg(F.min("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, WEIGHTS[1]).when(F.col("quality") == 0, WEIGHTS[0]).otherwise(WEIGHTS[None])
    rows = rows.withColumn("name", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    rows = rows.join(quality, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    rows = rows.withColumn("weight", weight).drop("quality").withColumn("key", exponential_key(F.col("weight")))
    rows = materialize(rows.withColumn("bucket", F.floor(F.log("key") * BUCKETS).cast("int")), "mixture")

    sums = rows.groupBy("name", "bucket").agg(F.sum("tokens").alias("tokens"))
    held = sums.groupBy("name").agg(F.sum("tokens").alias("held"))
    if shares is None:
        target = held.withColumn("share", F.lit(1.0))
    else:
        named = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "name string, share double")
        target = held.join(named, "name", "left").fillna(0.0, ["share"])
    whole = target.agg(F.sum("held").alias("all"), F.sum("share").alias("shares"))
    total = F.col("all") if total_tokens is None else F.lit(int(total_tokens))
    budget = F.when(F.col("shares") > 0, F.floor(total * (F.col("share") / F.col("shares")))).otherwise(F.lit(0)).cast("bigint")
    target = target.crossJoin(F.broadcast(whole)).withColumn("budget", budget)  # one row on the broadcast side
    target = target.withColumn("epochs", F.when(F.col("held") > 0, F.expr("budget div held")).otherwise(F.lit(0))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("held"))
    before = F.sum("tokens").over(W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    last = sums.withColumn("before", before).join(target.select("name", "rest"), "name").where("before + tokens > rest")
    last = last.groupBy("name").agg(F.min(F.struct("bucket", "before")).alias("at"))
    cut = target.join(last, "name", "left").select("name", "epochs", "rest", F.coalesce(F.col("at.bucket"), F.lit(NO_BUCKET)).alias("last"), F.coalesce(F.col("at.before"), F.lit(0)).alias("before"))
    cut = materialize(cut, "cut")  # one row a source
    rows = rows.join(F.broadcast(cut) if cut.count() <= MOST_BROADCAST else cut, "name")
    edge = rows.where("bucket = last AND rest > 0")
    in_order = W.partitionBy("name").orderBy("key", "doc_id", "tokens", "row").rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("taken", (F.col("before") + F.sum("tokens").over(in_order) <= F.col("rest")).cast("bigint"))
    clear = rows.where("NOT (bucket = last AND rest > 0)").withColumn("taken", ((F.col("bucket") < F.col("last")) & (F.col("rest") > 0)).cast("bigint"))
    return clear.unionByName(edge).select("row", "doc_id", "source", "tokens", "weight", "epochs", "taken")


def mixture(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epochs, taken) of every row of ``docs``; it gets ``epochs + taken`` copies.

    ``shares``: relative weight of each source (a source that is not named
    gets nothing); None gives every source the same. ``total_tokens``: the
    budget over all sources; None is what the corpus holds. ``labels``
    (doc_id, quality): weight 1.0 for quality 1, 0.25 for 0, 0.5 without a
    label; of repeated labels the lowest counts.

    A null source is a source of its own, named ''. A null id is hashed as the
    empty string and has no label. Documents without tokens (null, empty and
    blank texts) cost nothing: they come with each epoch and with a prefix
    that passes them; texts of any length are counted whole. Ties of keys are
    broken by id, then tokens, then row; rows that repeat an id share its key,
    and each is taken and paid for by itself. Empty tables give empty tables;
    other columns are not read.
    """
    slim = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_tokens().alias("tokens"))
    return _decide(with_row_ids(slim, "row", "counted"), labels, shares, total_tokens).select("doc_id", "source", F.col("tokens").alias("n_tokens"), "weight", "epochs", "taken")


def _mixed(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None, total_tokens: int | None) -> tuple[DataFrame, list[str]]:
    """``docs`` with tokens, weight, epochs and copies in columns of names that it returns; rows of no copies are gone."""
    names = unused(docs.columns, "row_number", "n_tokens", "weight", "epochs", "copies")
    row, tokens, weight, epochs, copies = names
    numbered = with_row_ids(docs, row, "numbered", **{tokens: n_tokens()})
    slim = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col(tokens).alias("tokens"))
    choice = _decide(slim, labels, shares, total_tokens).where("epochs + taken > 0")
    choice = choice.select(F.col("row").alias(row), F.col("weight").alias(weight), F.col("epochs").alias(epochs), (F.col("epochs") + F.col("taken")).alias(copies))
    return numbered.join(choice, row).drop(row), names[1:]


def mix_sources(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, total_tokens: int | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``weight``, ``epochs`` and ``copies``, rows of no copies dropped; see ``mixture``.

    Columns of ``docs`` named as result columns are replaced.
    """
    made = ("n_tokens", "weight", "epochs", "copies")
    kept = [c for c in docs.columns if c.lower() not in made]
    rows, names = _mixed(docs, labels, shares, total_tokens)
    return rows.select(*all_of(kept), *[F.col(n).alias(m) for n, m in zip(names, made)])


def mixed_copies(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, total_tokens: int | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it, all its columns as they are, whatever their names."""
    rows, names = _mixed(docs, labels, shares, total_tokens)
    return repeat_copies(rows, docs.columns, names[-1])


def repeat_copies(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says (none if it is null or below 1), with ``columns`` only.

    A row of a tiny source may be due a great many copies: above ``RUN`` they
    are made by as many tasks as there are runs of that length.
    """
    run, nth = unused(mixed.columns, "run", "nth")
    few = mixed.where(F.col(copies).between(1, RUN)).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    many = mixed.where(F.col(copies) > RUN).withColumn(run, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{copies}` - 1) div {RUN}"))))
    many = many.repartition(F.xxhash64(run, *all_of(columns[:1])))
    many = many.withColumn(nth, F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col(copies) - F.col(run) * RUN).cast("int"))))
    return few.select(*all_of(columns)).unionByName(many.select(*all_of(columns)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = mixture(docs, labels).withColumn("copies", F.col("epochs") + F.col("taken")).where("copies > 0")
    return rows.select("doc_id", "source", "n_tokens", "weight", "epochs", "copies")


OP3_SQL = f"""
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce(source, '') AS src,
        CASE WHEN trim(coalesce(text, ''), E' \\t\\r\\n') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \\t\\r\\n'), '[ \\t\\r\\n]+')) END AS n_tokens FROM documents),
w AS (SELECT d.*, CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
k AS (SELECT *, -ln((CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / weight AS key FROM w),
h AS (SELECT src, sum(n_tokens)::BIGINT AS held FROM k GROUP BY src),
b AS (SELECT src, held, CAST(floor((SELECT sum(held) FROM h) * (1.0::DOUBLE / (SELECT count(*) FROM h))) AS BIGINT) AS budget FROM h),
e AS (SELECT src, CASE WHEN held > 0 THEN budget // held ELSE 0 END AS epochs, CASE WHEN held > 0 THEN budget - (budget // held) * held ELSE budget END AS rest FROM b),
c AS (SELECT k.*, e.epochs, e.rest, sum(n_tokens) OVER (PARTITION BY k.src ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN e ON k.src = e.src)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, weight, epochs, epochs + CAST(rest > 0 AND run <= rest AS BIGINT) AS copies
FROM c WHERE epochs + CAST(rest > 0 AND run <= rest AS BIGINT) > 0"""
