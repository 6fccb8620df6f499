"""Source trees: listings by git or by walking, file contents, hashes, revisions."""

from __future__ import annotations

import codecs
import os
import stat
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.globs import Rule, is_ignored, path_glob, read_rules
from loomgraph.functions.scalars import language_for
from loomgraph.schema import SCANNED, InvalidInput

#: Files that one task looks at.
PER_TASK = 20_000
SKIPPED_DIRS = {".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", "target", ".idea"}


def git(root: str, *args: str) -> str | None:
    """Output of a git command in a folder; None if it fails."""
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def git_head(root: str) -> str:
    return (git(root, "rev-parse", "HEAD") or "").strip()


def git_branch(root: str) -> str:
    return (git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip()


def changed_files(spark: SparkSession, root: str, since: str) -> DataFrame:
    """(path) of files that differ between a revision and the current one."""
    listed = git(root, "diff", "--name-only", "-z", f"{since}..HEAD")
    if listed is None:
        raise InvalidInput(f"not a revision: {since}")
    return spark.createDataFrame([(p,) for p in listed.split("\0") if p], "path string")


def ignore_rules(root: str) -> list[Rule]:
    """Rules of all ignore files of a tree, outer folders first."""
    rules: list[Rule] = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS)
        if ".gitignore" in names:
            base = os.path.relpath(folder, root).replace(os.sep, "/")
            rules += read_rules(Path(folder, ".gitignore").read_text(errors="replace"), "" if base == "." else base)
    return rules


def _excluded(path: str, patterns: list[str]) -> bool:
    import re

    return any(re.match(path_glob(p), path if "/" in p else path.rsplit("/", 1)[-1]) for p in patterns)


def git_listing(root: str) -> list[str]:
    """Tracked and untracked files that aren't ignored; nothing outside a repository."""
    listed = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return sorted({p.replace("\\", "/") for p in (listed or "").split("\0") if p})


def walk_listing(root: str, rules: list[Rule]) -> Iterator[str]:
    """Files below a folder, without the usual build folders, ignored ones, and links that leave it."""
    top = os.path.realpath(root)
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS and not d.startswith("bazel-") and not is_ignored(rel + d, True, rules))
        for name in sorted(names):
            inside = os.path.realpath(os.path.join(folder, name)).startswith(top + os.sep)
            if inside and not is_ignored(rel + name, False, rules):
                yield rel + name


def scan(spark: SparkSession, root: str, no_gitignore: bool = False, exclude: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """Files of known languages: absolute_path, relative_path, language, size_bytes, mtime_ns, by path.

    The driver lists names only; the tasks look at the files, so every
    executor must be able to read ``root`` (an error if one can't).
    """
    paths = git_listing(root) if not no_gitignore and os.path.isdir(os.path.join(root, ".git")) else []
    if not paths:
        paths = sorted(walk_listing(root, [] if no_gitignore else ignore_rules(root)))
    named = [(p, language) for p in paths if (language := language_for(os.path.splitext(p)[1])) and not _excluded(p, exclude or [])]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                require_folder(root)
            rows = []
            for p, language in zip(pdf["relative_path"], pdf["language"]):
                full = os.path.join(root, p)
                try:
                    s = os.stat(full)
                except OSError:  # gone since it was listed
                    continue
                if stat.S_ISREG(s.st_mode):
                    rows.append((full, p, language, s.st_size, s.st_mtime_ns))
            yield pd.DataFrame(rows, columns=["absolute_path", "relative_path", "language", "size_bytes", "mtime_ns"])

    listed = spark.createDataFrame(named, "relative_path string, language string")
    if len(named) > PER_TASK:
        listed = listed.repartition(-(-len(named) // PER_TASK))
    found = listed.mapInPandas(look, SCANNED)
    return first_files(found, max_files)


def first_files(found: DataFrame, max_files: int | None) -> DataFrame:
    """The first files by path, if a number of them is given."""
    return found if max_files is None else found.orderBy("relative_path").limit(max_files)


def require_folder(root: str) -> None:
    """An error where an executor does not see a tree: without it all its files would seem to be gone."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"{root} can't be read here; it must be on a file system that all executors share")


def safe_path(path: str, root: str) -> str | None:
    """The file that a relative path means below a root; None for absolute paths, ways out of it, and what is no file."""
    if not path or os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
        return None
    full = os.path.realpath(os.path.join(root, path))
    return full if full.startswith(os.path.realpath(root) + os.sep) and os.path.isfile(full) else None


def content_hash(content: str | Column) -> Column:
    """XXH3-64 of bytes as 16 hexadecimal digits, read in Arrow's buffers as they are."""

    def digest(values: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_hexdigest(v.as_buffer()) if v.is_valid else None for v in values], pa.string())

    digest.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(digest, "string")(content)


def text_of(content: bytes) -> tuple[str, str | None]:
    """(text, what is wrong with it): UTF-8, or UTF-16 by its mark; other bytes become replacement characters."""
    if content[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        text, kind = content.decode("utf-16", "replace"), "UTF-16"
    else:
        text, kind = content.decode("utf-8-sig", "replace"), "UTF-8"
    fault = f"not {kind}" if "\ufffd" in text and "\ufffd".encode() not in content else None
    if "\0" in text:
        text, fault = text.replace("\0", " "), "binary"
    return text, fault


def read_contents(scanned: DataFrame) -> DataFrame:
    """Scanned files with ``content``, ``text`` and ``read_error``; the tasks read them.

    Bytes of any kind have a text (see ``text_of``, whose finding is the
    error). A file that can't be read has no content, an empty text and the
    reason; one that vanished since the scan is left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    content = Path(r.absolute_path).read_bytes()
                    text, error = text_of(content)
                except FileNotFoundError:
                    require_folder(r.absolute_path[: -len(r.relative_path)])
                    continue
                except OSError as e:
                    content, text, error = None, "", f"unreadable: {e.strerror}"
                rows.append((*r, content, text, error))
            yield pd.DataFrame(rows, columns=[*pdf.columns, "content", "text", "read_error"])

    return scanned.mapInPandas(run, SCANNED + ", content binary, text string, read_error string")
