"""Pages, budgets and projections of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomgraph.schema import InvalidInput

FIELDS = ("node_id", "kind", "name", "qualname", "signature", "file", "visibility", "doc", "start_line", "span")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows in order; sorts no more than the page's end, as a top-k."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_meta(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(total, has_more, next_offset) of a listing, in one pass."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    more = F.col("total") > offset + limit
    return total.select("total", more.alias("has_more"), F.when(more, F.lit(offset + limit).cast("bigint")).alias("next_offset"))


def budget_prefix(rows: DataFrame, order: list[Column], cost: Column, max_bytes: int, base: int = 384, limit: int | None = None) -> DataFrame:
    """The longest prefix whose costs (one byte more for each row) fit ``max_bytes`` with ``base``; the first row always stays.

    ``max_bytes`` 0 is no budget. The rows are a page already: the running sum
    is over at most ``limit`` rows, which bounds the single task that does it.
    """
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    if max_bytes <= 0:
        return rows
    w = W.orderBy(*order)
    before = F.coalesce(F.sum(F.col("__cost") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("__cost", cost).withColumn("__nth", F.row_number().over(w)).withColumn("__before", before)
    return out.where((F.col("__nth") == 1) | (F.lit(base) + F.col("__before") + F.col("__cost") <= max_bytes)).drop("__cost", "__nth", "__before")


def top_k(counts: DataFrame, count: str, name: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc(count), name).limit(k)


def best_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def first_groups(rows: DataFrame, group: str, order: list[Column], groups: int, per_group: int) -> DataFrame:
    """The first rows of the first groups: ``per_group`` rows of each of ``groups`` groups by ascending key."""
    keys = rows.select(group).distinct().orderBy(group).limit(groups)
    nth = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.join(keys, group, "left_semi").withColumn("__nth", nth).where(F.col("__nth") <= per_group).drop("__nth")


def select_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Listing columns by name; ``span`` is [start, end]. Unknown names are an error."""
    bad = [f for f in fields if f not in FIELDS]
    if bad or not isinstance(fields, list):
        raise InvalidInput(f"unknown fields: {bad}")
    made = {"node_id": F.col("id"), "file": F.col("file_path"), "span": F.array("start_line", "end_line")}
    return rows.select(*[made.get(f, F.col(f)).alias(f) for f in fields])


def shape(rows: DataFrame, compact: bool = False, handles: bool = False) -> DataFrame:
    """Lean rows; with ``handles`` ids and spans, with ``compact`` no qualname that repeats the name."""
    if not handles:
        return rows.select("kind", "name", "signature", F.col("file_path").alias("file"), "start_line")
    qual = F.nullif(F.col("qualname"), F.col("name")) if compact else F.col("qualname")
    return rows.select(F.col("id").alias("node_id"), "kind", "name", qual.alias("qualname"), "signature", F.col("file_path").alias("file"), "start_line", "end_line")
