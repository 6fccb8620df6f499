"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (an
offset and a skip, both hashes of its name). Shards take turns: each claims
the first slot of its order that is still free, until the table is full. So
each shard owns a share of the slots that differs by at most one, and a shard
that joins or leaves moves few slots besides its own. A document goes to the
owner of slot ``hash(doc_id) mod size``: one lookup in a broadcast table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import all_of, unused

SIZE, SHARDS, MOST = 65_537, 64, 1 << 20


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The index into ``shards`` that owns each slot.

    Raises ValueError for no shards, repeated names, more shards than slots, a
    size that is not prime or one above 2**20 (the table is broadcast).
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    if not is_prime(size) or size > MOST:
        raise ValueError(f"size must be a prime up to {MOST}")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    nxt = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            at = nxt[i]
            while owner[at] >= 0:
                at = (at + skip[i]) % size
            owner[at], nxt[i] = i, (at + skip[i]) % size
            free -= 1
            if not free:
                break
    return np.array(owner, np.int32)


def slot_of(key: str, size: int = SIZE):
    """Column: the slot of a key; a null key has the slot of the empty string."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % size


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """The table as (slot, shard) rows; ``size`` rows however large the corpus."""
    owner = fill_table(shards, size)
    return spark.createDataFrame(pd.DataFrame({slot: np.arange(size, dtype=np.int64), shard: owner}))


def assign_shards(docs: DataFrame, shards: list[str] | None = None, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` BIGINT and ``shard`` INT (an index into ``shards``).

    A map over rows: nothing is shuffled, and the broadcast side always has
    ``size`` rows of 12 bytes. Every row is placed, a null key too; rows that
    repeat a key go to one shard; an empty table gives an empty table. Columns
    of ``docs`` named ``slot`` or ``shard`` are replaced; any others stay.
    """
    slot, shard = unused(docs.columns, "slot_number", "shard_number")
    table = lookup(docs.sparkSession, shards if shards is not None else shard_names(), size, slot, shard)
    kept = all_of([c for c in docs.columns if c.lower() not in ("slot", "shard")])
    placed = docs.withColumn(slot, slot_of(key, size)).join(F.broadcast(table), slot)
    return placed.select(*kept, F.col(slot).alias("slot"), F.col(shard).alias("shard"))


def op10_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs)


def op10_sql() -> str:
    """The same lookup in DuckDB; the filled table itself is tested against its definition."""
    owners = ",".join(map(str, fill_table(shard_names())))
    return f"""
WITH t AS (SELECT unnest([{owners}]) AS shard, unnest(range({SIZE})) AS slot)
SELECT d.doc_id, d.slot, CAST(t.shard AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SIZE} AS slot FROM documents) d
JOIN t ON d.slot = t.slot"""
