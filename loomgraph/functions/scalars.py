"""Scalar functions as Column expressions; none needs Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMON_MEMBERS = ("get", "set", "add", "delete", "remove", "has", "push", "pop", "call", "apply", "map", "filter", "find", "update", "create", "run")
NOT_NAMES = ("new", "this", "self", "super", "null", "nil", "true", "false")
SHAPES = ("callback", "string", "number", "bool", "array", "object", "null", "identifier", "member", "call", "expr")

_EXTENSIONS = {
    "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "inl": "cpp", "cs": "csharp", "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyw": "python", "rs": "rust", "java": "java", "go": "go",
    "sh": "bash", "bash": "bash", "sql": "sql", "tsql": "sql", "yaml": "yaml", "yml": "yaml",
}


def language_for(extension: str) -> str:
    return _EXTENSIONS.get(extension.lower().lstrip("."), "")


def language_of(path: Column) -> Column:
    """The language of a path by its extension; '' if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in sorted(_EXTENSIONS.items()) for x in pair])
    return F.coalesce(F.element_at(table, ext), F.lit(""))


def camel_split(x: Column) -> Column:
    """The name followed by its camel-case parts, or the name alone if there is but one part."""
    parts = F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.when(parts == x, x).when(x.isNotNull(), F.concat_ws(" ", x, parts))


def same_name(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)


def ends_in_part(text: Column, suffix: Column) -> Column:
    """Whether text is longer than suffix, ends in it, and a separator precedes it."""
    t, s = F.lower(text), F.lower(suffix)
    before = F.substring(t, F.length(t) - F.length(s), F.lit(1))
    return (F.length(s) > 0) & (F.length(t) > F.length(s)) & F.endswith(t, s) & before.isin(".", ":", "#", "/", ">")


def trailing_identifier(x: Column) -> Column:
    return F.regexp_extract(x, r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)


def owner_of(qualname: Column) -> Column:
    """What precedes the last separator of a qualified name; '' without one."""
    return F.regexp_extract(qualname, r"^(.*)(::|\.|#|/)", 1)


def clean_receiver(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|[\s?]+$", "")


def without_generics(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<.*$", "")


def plain_type(x: Column) -> Column:
    """A type hint reduced to a name: modifiers, alternatives, generics, arrays and pointers dropped."""
    y = F.regexp_replace(F.trim(x), r"^(?:readonly |typeof )+", "")
    y = F.trim(F.regexp_replace(y, r"(?s)[|&=].*$", ""))
    return F.regexp_replace(F.trim(without_generics(y)), r"(?:\[\]|[*&?\s])+$", "")


def receiver_of(callee: Column, name: Column) -> Column:
    """The text before ``.name``, ``::name`` or ``->name``; null for another form."""
    forms = [(F.endswith(callee, F.concat(F.lit(sep), name)), len(sep)) for sep in (".", "::", "->")]
    return reduce(lambda rest, f: F.when(f[0], F.substring(callee, F.lit(1), F.length(callee) - F.length(name) - F.lit(f[1]))).otherwise(rest), reversed(forms), F.lit(None).cast("string"))


def is_common_member(x: Column) -> Column:
    return F.lower(x).isin(*COMMON_MEMBERS)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"/test|/mock|/fake|/stub|_test\.|_mock\.|_fake\.|test_")


def last_part(ref: Column) -> Column:
    """The name behind the last ``.``, ``::`` or ``->``; null without a separator."""
    part = F.regexp_extract(ref, r"^.*(?:\.|::|->)([^.:>]+)$", 1)
    return F.when(part != "", part)


def bare_name(ref: Column) -> Column:
    """The name under which another root may know a reference; null for keywords and empty names."""
    part = F.coalesce(last_part(ref), ref)
    name = F.when(F.length(part) < 4, ref).otherwise(part)
    return F.when((part != "") & ~F.lower(part).isin(*NOT_NAMES), name)


def cross_root_confidence(is_definition: Column, same_language: Column, receiver_agrees: Column) -> Column:
    weight = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.4) + weight(is_definition, 0.2) + weight(same_language, 0.15) + weight(receiver_agrees, 0.25))


def first_line(doc: Column) -> Column:
    return F.trim(F.element_at(F.split(doc, "\n"), 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def module_of(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def slot_timeout_ms(size: Column, base_ms: int) -> Column:
    return F.least(F.lit(base_ms) + F.expr("10L") * F.floor(size / 1024), F.lit(10_000)).cast("bigint")


def age_seconds(iso: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp(iso))


def collapse_signature(node_text: Column) -> Column:
    """Text before the first brace, white space collapsed, 512 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(node_text, r"(?s)\{.*$", ""), r"\s+", " ")), 1, 512)


def fold_tokens(text: Column) -> Column:
    """Lowered tokens of letters and digits, common Latin diacritics removed."""
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.array_remove(F.split(F.translate(F.lower(text), marked, plain), r"[^\p{L}\p{N}]+"), "")


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def is_public(visibility: Column, qualname: Column, name: Column, kind: Column) -> Column:
    """Stated public, or not stated for a top-level symbol of an API-like kind."""
    top = qualname.isNull() | (qualname == "") | (qualname == name)
    api = kind.isin("class", "interface", "struct", "enum", "type_alias", "trait", "function")
    return F.coalesce(visibility == "public", F.lit(False)) | (visibility.isNull() & top & api)


def spans_at_least(start: Column, end: Column, n: int) -> Column:
    return F.coalesce(end - start + 1 >= n, F.lit(n <= 0))


def call_shape(shape: Column) -> Column:
    """The canonical shape of an argument: ``new:X`` is an object, unlisted ones are unknown."""
    low = F.lower(shape)
    return F.when(low.startswith("new:"), F.lit("object")).when(low.isin("string", "number", "bool", "object", "array", "callback"), low).otherwise(F.lit("unknown"))


def pattern_bonus(call: Column, params: Column) -> Column:
    """0.04 times the share of comparable argument shapes that agree; 0 for unequal counts."""
    a = F.transform(F.split(call, ","), call_shape)
    b = F.transform(F.split(params, ","), call_shape)
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != "unknown") & (p["b"] != "unknown"))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(pairs) == 0, 0.0).otherwise(0.04 * same / F.size(pairs))


def receiver_strength(receiver: Column, owner: Column, owner_qualname: Column) -> Column:
    """How a receiver names an owner: 3 exactly, 2 as a suffix, 1 by its last identifier, 0 not at all."""
    some = (F.coalesce(receiver, F.lit("")) != "") & (F.coalesce(owner, F.lit("")) != "")
    exact = same_name(receiver, owner) | F.coalesce(same_name(receiver, owner_qualname), F.lit(False))
    suffix = ends_in_part(receiver, owner) | F.coalesce(ends_in_part(owner_qualname, receiver), F.lit(False))
    bare = same_name(trailing_identifier(receiver), trailing_identifier(owner)) & (trailing_identifier(owner) != "")
    return F.when(~some, 0).when(exact, 3).when(suffix, 2).when(bare, 1).otherwise(0)


def receiver_passes(hint: Column, type_hint: Column, wanted: str) -> Column:
    """Whether the receiver's text or type matches a name: equal, a suffix of it or the reverse, or the same last identifier."""

    def match(c: Column) -> Column:
        w = F.lit(wanted)
        same = same_name(c, w) | ends_in_part(c, w) | ends_in_part(w, c) | (same_name(trailing_identifier(c), trailing_identifier(w)) & (trailing_identifier(w) != ""))
        return F.coalesce((c != "") & same, F.lit(False))

    return match(hint) | match(type_hint)


def listing_cost(*columns: Column) -> Column:
    """Bytes that a listing row is reckoned at: its texts and 64 for the rest."""
    return reduce(lambda a, c: a + F.coalesce(F.octet_length(c), F.lit(0)), columns, F.lit(64)).cast("bigint")
