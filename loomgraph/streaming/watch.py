"""Change feeds: classification, debouncing, known-file state, incremental indexing."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.graph import current_version, empty_graph, kv_get, load, save
from loomgraph.plans.indexing import index
from loomgraph.schema import InvalidInput
from loomgraph.scratch import drop_table, materialize
from loomgraph.sources.scan import git_head, scan

POLICIES = ("eager", "normal", "lazy", "off")


def event_type(path: Column, existed: Column, exists: Column) -> Column:
    """BranchSwitch for a repository's head and refs, else Created, Modified or Deleted."""
    switch = path.rlike(r"(^|/)\.git/(HEAD$|refs/)")
    return F.when(switch, "BranchSwitch").when(~exists, "Deleted").when(~existed, "Created").otherwise("Modified")


def is_relevant(path: Column, own_dir: str = ".loomgraph") -> Column:
    """Not our own files, and of a repository's only head and refs."""
    inside_git = path.rlike(r"(^|/)\.git/") & ~path.rlike(r"(^|/)\.git/(HEAD$|refs/)")
    return ~(F.contains(path, F.lit(f"{own_dir}/")) | inside_git)


def snapshot_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, type) between two snapshots (path, mtime_ns): the deletions too, which a file stream never reports."""
    a, b = before.select("path", F.col("mtime_ns").alias("m0")), after.select("path", F.col("mtime_ns").alias("m1"))
    both = a.join(b, "path", "full").where("m0 IS NULL OR m1 IS NULL OR m0 <> m1")
    return both.where(is_relevant(F.col("path"))).select("path", event_type(F.col("path"), F.col("m0").isNotNull(), F.col("m1").isNotNull()).alias("type"))


def debounce(events: DataFrame, ts: str, key: str, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Bursts of events of a key, closed by a pause: (key, first, last, n). Works on streams and tables."""
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return stamped.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "first", "last", "n")


def windowed_counts(events: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "1 hour", *keys: str) -> DataFrame:
    """Counts by tumbling or sliding window, late events up to a bound counted."""
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return stamped.groupBy(F.window(ts, size, slide or size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def known_files(events: DataFrame) -> DataFrame:
    """Stream of (path, type) from a stream of (path, mtime_ns, exists): a state per path remembers its last time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        (path,) = key
        last = state.get[0] if state.exists else None
        types = []
        for pdf in batches:
            for r in pdf.itertuples():
                if not r.exists:
                    types += ["Deleted"] if last is not None else []
                    last = None
                elif last != r.mtime_ns:
                    types.append("Created" if last is None else "Modified")
                    last = int(r.mtime_ns)
        if types:
            yield pd.DataFrame({"path": path, "type": types})
        if last is None:
            state.remove() if state.exists else None
        else:
            state.update((last,))

    return events.groupBy("path").applyInPandasWithState(step, "path string, type string", "mtime_ns bigint", "append", GroupStateTimeout.NoTimeout)


def poll(spark: SparkSession, root: str, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(events since the last snapshot, snapshot) of a tree."""
    now = materialize(scan(spark, root).select(F.col("relative_path").alias("path"), "mtime_ns"), "snapshot")
    return snapshot_events(seen if seen is not None else now.where("false"), now), now


def index_version(spark: SparkSession, root: str, store: str, **options) -> int:
    """Index a tree on top of the latest stored version, and store the next."""
    base = load(spark, store) if current_version(spark, store) else empty_graph(spark)
    return save(index(spark, root, base, **options), store)


def watch(spark: SparkSession, root: str, store: str, trigger: str = "2 seconds", on_version: Callable[[int], None] | None = None) -> StreamingQuery:
    """Keep a stored graph up to date: at each trigger the tree is compared with the last snapshot and, if it changed, indexed.

    Triggers never overlap, so requests that come during a run are served by
    the next one.
    """
    held: dict[str, DataFrame] = {}

    def tick(_: DataFrame, __: int) -> None:
        events, now = poll(spark, root, held.get("seen"))
        if not events.isEmpty():
            version = index_version(spark, root, store)
            if on_version:
                on_version(version)
        if "seen" in held:
            drop_table(held["seen"])
        held["seen"] = now

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).trigger(processingTime=trigger).start()


class Reindexer:
    """Runs of one function in the background; requests during a run make one more run."""

    def __init__(self, run: Callable[[], object]) -> None:
        self.run, self.lock, self.running, self.queued, self.runs = run, threading.Lock(), False, False, 0

    def request(self) -> str:
        with self.lock:
            if self.running:
                self.queued = True
                return "queued"
            self.running = True
        threading.Thread(target=self._loop, daemon=True).start()
        return "started"

    def _loop(self) -> None:
        while True:
            self.run()
            with self.lock:
                self.runs += 1
                if not self.queued:
                    self.running = False
                    return
                self.queued = False

    def wait(self, seconds: float = 60.0) -> bool:
        end = time.time() + seconds
        while self.running and time.time() < end:
            time.sleep(0.01)
        return not self.running


def is_stale(g, root: str) -> bool:
    """Whether the revision that was indexed is not the current one."""
    return os.path.isdir(root) and kv_get(g.kv, "git_head") != git_head(root)


def freshen(policy: str, stale: bool, reindex: Callable[[], object], background: Reindexer | None = None) -> str:
    """What a policy does about a stale graph before a query: block, reindex behind it, or nothing."""
    if policy not in POLICIES:
        raise InvalidInput(f"unknown policy: {policy}")
    if not stale or policy in ("lazy", "off"):
        return "kept"
    if policy == "eager":
        reindex()
        return "reindexed"
    return (background or Reindexer(reindex)).request()
