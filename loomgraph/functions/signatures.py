"""Parameter lists and call arguments: splitting, counting and classifying."""

from __future__ import annotations

import re

_OPEN, _CLOSE = "([{<", ")]}>"


def split_top(text: str) -> list[str]:
    """The parts between commas outside brackets and quotes; nothing for an empty list or ``void``."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            if c == quote and text[i - 1] != "\\":
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            if c != ">" or text[i - 1 : i] not in ("=", "-"):
                depth = max(0, depth - 1)
        elif c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    parts.append(text[start:].strip())
    return [] if parts in ([""], ["void"]) else parts


def has_top(text: str, wanted: str) -> bool:
    """Whether a character occurs outside brackets and quotes."""
    depth, quote = 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c == wanted and depth == 0 and not (wanted == "=" and text[i + 1 : i + 2] == ">"):
            return True
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE and (c != ">" or text[i - 1 : i] not in ("=", "-")):
            depth = max(0, depth - 1)
    return False


def is_optional(param: str) -> bool:
    colon = param.find(":")
    mark = param.find("?")
    return has_top(param, "=") or 0 <= mark < (colon if colon >= 0 else mark + 1) or param.startswith(("...", "*"))


def param_shape(param: str) -> str:
    """callback, string, number, bool, array, object or unknown, by the first rule that fits."""
    low = param.lower()
    rules = (
        ("callback", ("=>", "callback", "function", "handler", "listener", "func<", "action<")), ("string", ("string", "str:", ": str", "char*", "char *", "&str")),
        ("number", ("number", "int", "float", "double", "long", "short", "size_t", "decimal", "u32", "i32", "u64", "i64")), ("bool", ("bool",)),
        ("array", ("[]", "array", "list", "vector", "slice")), ("object", ("object", "record<", "map<", "dict", "{")),
    )
    return next((shape for shape, words in rules if any(w in low for w in words)), "unknown")


def call_signature(text: str | None, name: str | None) -> tuple[int, int, str] | None:
    """(least count, count, shapes joined by commas) of the parameter list that follows ``name``."""
    if not text or not name:
        return None
    for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(name)}\s*(?:<[^()]*>)?\s*\(", text):
        depth, start = 1, m.end()
        for i in range(start, len(text)):
            depth += (text[i] == "(") - (text[i] == ")")
            if depth == 0:
                params = split_top(text[start:i])
                least = next((n for n, p in enumerate(params) if is_optional(p)), len(params))
                return least, len(params), ",".join(map(param_shape, params))
    return None


def argument_shape(arg: str) -> str:
    """The shape of a call's argument by its text."""
    a = arg.strip()
    if re.match(r"""^[rbfuRBFU@$]*["'`]""", a):
        return "string"
    if re.match(r"^-?\d", a):
        return "number"
    if a in ("true", "false", "True", "False"):
        return "bool"
    if a in ("null", "nil", "None", "nullptr", "undefined"):
        return "null"
    if re.match(r"^(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>|lambda\b|\[[^\]]*\]\s*\(|\|[^|]*\|)", a):
        return "callback"
    if a.startswith("{"):
        return "object"
    if a.startswith("["):
        return "array"
    if m := re.match(r"^new\s+([A-Za-z_][\w.]*)", a):
        return f"new:{m[1].split('.')[-1]}"
    if re.match(r"^[A-Za-z_$][\w$]*$", a):
        return "identifier"
    if re.match(r"^[A-Za-z_$][\w$.>:-]*\(.*\)$", a, re.S):
        return "call"
    if re.match(r"^[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)+$", a):
        return "member"
    return "expr"


def arguments(text: str) -> tuple[int, str]:
    """(count, shapes joined by commas, 128 characters at most) of what stands between a call's brackets."""
    parts = split_top(text)
    return len(parts), ",".join(map(argument_shape, parts))[:128]
