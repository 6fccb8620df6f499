"""Names for temporary columns, and rows that can be told apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import materialize


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened by underscores until none is a column's (Spark compares names without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def all_of(columns: list[str]) -> list:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def with_row_ids(df: DataFrame, name: str, tag: str, **more) -> DataFrame:
    """``df``, written once to the shared folder, with a number that no two rows share (and ``more`` columns).

    The numbers are fixed by the write, so every later read of a lost
    partition sees the same ones.
    """
    return materialize(df.withColumns(more).withColumn(name, F.monotonically_increasing_id()), tag)


def filter_by_text(docs: DataFrame, judge: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows whose ``text`` a task's judge keeps, all columns as they are, whatever their names hold."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = judge()
        for batch in batches:
            yield batch.filter(kept(batch.column(at)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
