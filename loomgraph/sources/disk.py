"""Indexed files on disk: their text as it is now, and whether the graph knows that state."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.graph import Graph, kv_get
from loomgraph.operators.listing import resolve_file
from loomgraph.schema import InvalidInput, NotFound
from loomgraph.sources.scan import safe_path, text_of

MOST_LINES = 500


@dataclass(frozen=True)
class FileNow:
    """An indexed file: the graph's path, the text on disk (None if it is gone), and whether it changed since."""

    path: str
    text: str | None
    stale: bool

    def lines(self, start: int, end: int) -> str:
        """Lines from 1, both ends included, each ended by a line feed."""
        if self.text is None:
            return ""
        return "".join(line + "\n" for line in self.text.removesuffix("\n").split("\n")[start - 1 : end])


def file_now(g: Graph, path: str, root: str = "") -> FileNow:
    """The file that a path means. Files of added roots lie below those roots, others below ``root`` or the indexed one.

    What does not lie below its root is not read: that is an error, like a path that is not indexed.
    """
    known = resolve_file(g, path, root or kv_get(g.kv, "repo_root"))
    row = g.files.where(F.col("path") == known).select("root_id", "size_bytes", "mtime_ns").first()
    base, relative = root or kv_get(g.kv, "repo_root"), known
    if row["root_id"] is not None:
        added = g.roots.where(F.col("id") == row["root_id"]).first()
        base = added["path"] if added else ""
        relative = known.removeprefix(base.rstrip("/") + "/")
    if os.path.isabs(relative) or ".." in relative.split("/"):
        raise InvalidInput(f"outside of its root: {path}")
    full = safe_path(relative, base) if base else None
    if full is None:
        return FileNow(known, None, True)
    s = os.stat(full)
    return FileNow(known, text_of(Path(full).read_bytes())[0], (s.st_size, s.st_mtime_ns) != (row["size_bytes"], row["mtime_ns"]))


def source_at(g: Graph, path: str, start_line: int, end_line: int, root: str = "") -> dict:
    """{path, start_line, end_line, source, stale} of lines of a file; 500 lines at most, ends beyond the file are cut."""
    if start_line < 1 or end_line < start_line:
        raise InvalidInput("lines run from 1 and the end is not before the start")
    if end_line - start_line >= MOST_LINES + 1:
        raise InvalidInput(f"{MOST_LINES} lines at most")
    now = file_now(g, path, root)
    source = now.lines(start_line, end_line)
    if not source:
        raise NotFound(f"no such lines: {path}:{start_line}-{end_line}")
    return {"path": now.path, "start_line": start_line, "end_line": start_line + source.count("\n") - 1, "source": source, "stale": now.stale}


def with_sources(g: Graph, symbols: list[dict], most_lines: int = 0, root: str = "") -> list[dict]:
    """Symbols (file_path, start_line, end_line) with ``source`` and ``stale``; files are read once."""
    held: dict[str, FileNow] = {}
    out = []
    for s in symbols:
        path, start, end = s.get("file_path"), s.get("start_line"), s.get("end_line")
        if not path or not start:
            out.append(s)
            continue
        if path not in held:
            held[path] = file_now(g, path, root)
        end = end or start
        cut = most_lines > 0 and end - start + 1 > most_lines
        source = held[path].lines(start, start + most_lines - 1 if cut else end)
        out.append({**s, "source": source + ("...(truncated)" if cut else ""), "stale": held[path].stale})
    return out
