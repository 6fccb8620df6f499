"""Shared scratch space: where lineage is cut and intermediate tables are written.

The folder is the one the cluster names in ``spark.checkpoint.dir``; every
executor can read it, so a lost executor loses nothing that was written there.
Where that setting is absent, a folder of our own is used in local mode (tests,
laptops) and deleted at exit; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths of written tables by the DataFrame that reads them.
_PATH = "_scratch_path"


class NoSharedFolder(RuntimeError):
    """A cluster without ``spark.checkpoint.dir``: executors could not read what others wrote."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names, or one of our own in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that every executor can read")
    if "dir" not in _own:
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own["dir"] = "file://" + folder
    return _own["dir"]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, and what is read back is a
    plain Parquet scan with column pruning and exact size statistics.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    setattr(written, _PATH, path)
    return written


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for a DataFrame that nothing reads any more."""
    path = getattr(df, _PATH, None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the Hadoop file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
