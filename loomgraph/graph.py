"""A graph: its tables as DataFrames, stored as versioned Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import TABLES, InvalidInput, StoreError

SCHEMA_VERSION = 8


class Later:
    """A table that is made when it is first read, and once."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.made = make, None

    def table(self) -> DataFrame:
        if self.made is None:
            self.made = self.make()
        return self.made


@dataclass(frozen=True)
class Graph:
    """Lazily evaluated tables; operators take a graph and return DataFrames or new graphs. A table given as a ``Later`` is made when it is read."""

    files: DataFrame
    nodes: DataFrame
    refs: DataFrame
    edges: DataFrame
    lines: DataFrame
    roots: DataFrame
    kv: DataFrame
    quarantine: DataFrame

    def __getattribute__(self, name: str):
        found = object.__getattribute__(self, name)
        return found.table() if isinstance(found, Later) else found

    @property
    def spark(self) -> SparkSession:
        return next(t for t in vars(self).values() if not isinstance(t, Later)).sparkSession

    def with_tables(self, **tables: DataFrame | Later) -> Graph:
        return Graph(**(vars(self) | tables))

    def located(self, nodes: DataFrame | None = None) -> DataFrame:
        """Nodes, all or the given ones, with their file's path and language; file nodes have none."""
        f = self.files.select(F.col("id").alias("__file"), F.col("path").alias("file_path"), F.col("language"))
        return (self.nodes if nodes is None else nodes).join(f, F.col("file_id") == F.col("__file"), "left").drop("__file")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order and of its types; missing ones are null."""
    parts = [c.strip().split(" ") for c in TABLES[table].split(",")]
    return df.select(*[(F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in parts])


#: Rows that a task joins or groups, at most, if keys are even.
TASK_ROWS = 250_000


def spread(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """Rows hashed by columns to as many parts as their number (counted, if not given) asks for, so that a task's share does not grow with the table; no fewer than the session's."""
    parts = -(-(df.count() if rows is None else rows) // TASK_ROWS)  # the count of a stored table is read from its footers
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by) if parts > usual else df.repartition(*by)


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(**{t: spark.createDataFrame([], s) for t, s in TABLES.items()})


def make_graph(spark: SparkSession, **tables: DataFrame) -> Graph:
    """A graph of the given tables; the rest are empty."""
    return empty_graph(spark).with_tables(**{t: conform(df, t) for t, df in tables.items()})


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> int:
    """The latest whole version below a path, 0 if there is none."""
    _, where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return 0
    done = [s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("v") and fs.exists(_hadoop(spark, f"{path}/{s.getPath().getName()}/_DONE")[1])]
    return max((int(n[1:]) for n in done), default=0)


def save(graph: Graph, path: str) -> int:
    """Write all tables as the next version; readers see it once its marker is there."""
    spark, version = graph.spark, current_version(graph.spark, path) + 1
    for f in fields(graph):
        df = conform(getattr(graph, f.name), f.name)
        # edges and refs are looked up by their ends, so files are clustered by them
        key = {"edges": "dst_id", "refs": "name", "nodes": "file_id", "lines": "file_id"}.get(f.name)
        (df.repartitionByRange(key) if key else df).write.mode("overwrite").parquet(f"{path}/v{version}/{f.name}")
    spark.createDataFrame([(json.dumps({"schema_version": SCHEMA_VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v{version}/_meta")
    _, where, fs = _hadoop(spark, f"{path}/v{version}/_DONE")
    fs.create(where).close()
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Graph:
    """The tables of a version, the latest by default; columns added since are null."""
    version = version or current_version(spark, path)
    if not version:
        raise InvalidInput(f"no graph at {path}")
    meta = json.loads(spark.read.text(f"{path}/v{version}/_meta").first()["value"])
    if meta["schema_version"] > SCHEMA_VERSION:
        raise StoreError(f"the graph has schema version {meta['schema_version']}; this code knows {SCHEMA_VERSION}")
    return Graph(**{t: conform(spark.read.parquet(f"{path}/v{version}/{t}"), t) for t in TABLES})


def migrate(tables: dict[str, DataFrame], spark: SparkSession) -> Graph:
    """Tables of an older schema brought to this one: added columns are null, missing tables empty."""
    return empty_graph(spark).with_tables(**{t: conform(df, t) for t, df in tables.items() if t in TABLES})


def kv_put(kv: DataFrame, pairs: dict[str, str]) -> DataFrame:
    new = kv.sparkSession.createDataFrame(list(pairs.items()), TABLES["kv"])
    return kv.join(new.select("key"), "key", "left_anti").unionByName(new)


def kv_get(kv: DataFrame, key: str, default: str = "") -> str:
    row = kv.where(F.col("key") == key).first()
    return row["value"] if row else default
