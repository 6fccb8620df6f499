"""Two dialects of path patterns, compiled to anchored regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(r".^$+{}()|\\")


def _quote(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _classes(pattern: str, i: int) -> tuple[str, int] | None:
    j = pattern.find("]", i + 2)
    if j < 0:
        return None
    body = pattern[i + 1 : j]
    negated = body[:1] in ("^", "!")
    body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
    return f"[{'^' if negated else ''}{body}]", j + 1


def sql_glob(pattern: str) -> str:
    """Regex of a pattern whose ``*`` crosses slashes; ``?`` is one character, ``[…]`` a class; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (got := _classes(pattern, i)):
            out.append(got[0])
            i = got[1]
            continue
        out.append(".*" if c == "*" else "." if c == "?" else "\\[" if c == "[" else _quote(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def path_glob(pattern: str) -> str:
    """Regex of a pattern whose ``*`` and ``?`` stay within a directory and whose ``**`` crosses them."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\[" if c == "[" else _quote(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches_glob(text: Column, pattern: str) -> Column:
    return text.rlike(sql_glob(pattern))


def matches_path(path: Column, pattern: str) -> Column:
    """A pattern with a slash is held against the path, another against the last part."""
    return (path if "/" in pattern else F.element_at(F.split(path, "/"), -1)).rlike(path_glob(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | matches_path(path, p), patterns, F.lit(False))


def scope_glob(scope: str) -> str:
    """A scope without wildcards means everything below it."""
    return scope if re.search(r"[*?\[]", scope) else scope.rstrip("/") + "/*"


def in_directory(path: Column, directory: str) -> Column:
    """Whether a path is an immediate child of a directory ('.' is the top)."""
    if directory in ("", "."):
        return F.instr(path, "/") == 0
    prefix = directory.rstrip("/") + "/"
    return path.startswith(prefix) & (F.instr(F.substring(path, F.lit(len(prefix) + 1), F.length(path)), "/") == 0)


class Rule:
    """One line of an ignore file, below the directory that holds it."""

    def __init__(self, line: str, base: str = "") -> None:
        self.negated = line.startswith("!")
        line = line[self.negated :]
        self.only_dirs = line.endswith("/")
        line = line.rstrip("/")
        self.anchored = "/" in line
        self.base = base
        self.regex = re.compile(path_glob(line.lstrip("/")))

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.base:
            if not path.startswith(self.base + "/"):
                return False
            path = path[len(self.base) + 1 :]
        parts = path.split("/")
        for n in range(1, len(parts) + 1):  # an ignored directory hides all below it
            here_is_dir = is_dir or n < len(parts)
            if (not self.only_dirs or here_is_dir) and self.regex.match("/".join(parts[:n]) if self.anchored else parts[n - 1]):
                return True
        return False


def read_rules(text: str, base: str = "") -> list[Rule]:
    return [Rule(line.strip(), base) for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]


def is_ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """The last rule that matches decides."""
    verdict = False
    for rule in rules:
        if rule.matches(path, is_dir):
            verdict = not rule.negated
    return verdict
