"""Extraction of many files by the tasks."""

from __future__ import annotations

import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.extract import lexers, python_ast
from loomgraph.extract.base import MAX_SYMBOLS, Found
from loomgraph.schema import EXTRACTED

MAX_FILE_BYTES = 10_240 * 1024
SLOT_MS = 5000
#: Errors that send a file to the quarantine: another attempt would end the same way.
CRASHES = ("Timeout", "MemoryError", "RecursionError")


class Timeout(Exception):
    """A file took longer than its slot."""


@contextmanager
def time_limit(ms: int):
    """Raise Timeout in the block after so many milliseconds; only a main thread can be interrupted."""
    if ms <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise Timeout(f"{ms} ms")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, ms / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract_text(path: str, language: str, text: str | None, max_symbols: int = MAX_SYMBOLS, slot_ms: int = SLOT_MS) -> dict:
    """One file's extraction within its time (``slot_ms`` and 10 ms for each KB, twice as much at most); a language without an extractor is skipped, an error is kept in the row."""
    found = Found(max_symbols)
    status, error = "ok", None
    if language == "python":
        run = python_ast.extract
    else:
        run = lexers.EXTRACTORS.get(language)
    if run is None:
        status = "skipped"
    elif text:
        try:
            with time_limit(min(slot_ms + 10 * (len(text) // 1024), 2 * slot_ms)):
                run(text, found)
        except (SyntaxError, ValueError, RecursionError, MemoryError, Timeout) as e:
            status, error = "failed", f"{type(e).__name__}: {e}"[:500]
            found = Found(max_symbols)
    return {"path": path, "parse_status": "partial" if status == "ok" and found.truncated else status, "parse_error": error, "truncated": found.truncated, "symbols": found.symbols, "refs": found.refs, "edges": found.edges}


def extract(texts: DataFrame, max_symbols: int = MAX_SYMBOLS, max_bytes: int = MAX_FILE_BYTES, slot_ms: int = SLOT_MS) -> DataFrame:
    """Extractions of (path, language, text) rows, one nested row a file; files above the size cap are only recorded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                big = r.text is not None and len(r.text.encode()) > max_bytes
                one = extract_text(r.path, r.language, None if big else r.text, max_symbols, slot_ms)
                rows.append({**one, "parse_status": "partial"} if big else one)
            yield pd.DataFrame(rows, columns=["path", "parse_status", "parse_error", "truncated", "symbols", "refs", "edges"])

    return texts.select("path", "language", F.col("text").cast("string").alias("text")).mapInPandas(run, EXTRACTED)


class ExtractSymbols:
    """Table function body: (kind, name, start_line, end_line) of a text's symbols."""

    def eval(self, path: str, language: str, text: str):
        for s in extract_text(path, language, text)["symbols"]:
            yield s["kind"], s["name"], s["start_line"], s["end_line"]


def register(spark) -> None:
    """Make ``camel_split`` and ``extract_symbols`` callable from SQL."""
    from pyspark.sql.functions import udtf

    from loomgraph.functions.scalars import camel_split

    spark.udtf.register("extract_symbols", udtf(ExtractSymbols, returnType="kind string, name string, start_line int, end_line int"))
    parts = r"regexp_replace(x, '(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])', ' ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION camel_split(x STRING) RETURNS STRING RETURN CASE WHEN {parts} = x THEN x ELSE concat(x, ' ', {parts}) END")
    assert camel_split is not None
