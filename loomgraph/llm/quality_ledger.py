"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores one failure bit
per rule and the measurements behind the bits. Policies are versioned masks
over the bits: to apply one, or to change one, reads only the ledger. What
each rule costs a policy (its ablation) is a bitwise aggregation.

All rules are built-in expressions over integers (shares are compared by
cross-multiplication), so nothing leaves the JVM and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.scratch import materialize

STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "der", "die", "und", "das", "von", "ist", "le", "la", "les", "de", "et", "des", "que", "el", "los", "en", "y", "un", "une", "a")
SYMBOLS = "#$%&*@^|~<>{}=+_"

#: Measurements as SQL that Spark and DuckDB both read, over t (text), words and lines (arrays); {…} differs by dialect.
MEASURES = {
    "n_chars": "length(t)",
    "n_words": "{size}(words)",
    "n_word_chars": "length({translate}(t, ' \t\r\n', ''))",
    "n_letters": "length({replace}(t, '[^\\p{{L}}]+', ''))",
    "n_upper": "length({replace}(t, '[^\\p{{Lu}}]+', ''))",
    "n_digits": "length(t) - length({translate}(t, '0123456789', ''))",
    "n_symbols": "length(t) - length({translate}(t, '" + SYMBOLS.replace("{", "{{").replace("}", "}}") + "', ''))",
    "n_lines": "{size}(lines)",
    "n_distinct_lines": "{size}({distinct}(lines))",
    "n_distinct_words": "{size}({distinct}(words))",
    "n_stop_words": "{size}({intersect}({distinct}(words), {stops}))",
    "n_bullets": "{bullets}",
    "n_ellipses": "{ellipses}",
    "n_braces": "length(t) - length({translate}(t, '{{}}', ''))",
}

#: Rules by bit: (name, SQL that is true on failure, over the measurements).
RULES = [
    ("too_few_words", "n_words < 5"),
    ("too_many_words", "n_words > 200000"),
    ("short_mean_word", "n_words > 0 AND n_word_chars < 2 * n_words"),
    ("long_mean_word", "n_word_chars > 15 * n_words"),
    ("few_letters", "n_letters * 10 < n_word_chars * 7"),
    ("many_digits", "n_digits * 5 > n_word_chars"),
    ("many_symbols", "n_symbols * 10 > n_words * 3"),
    ("shouting", "n_letters >= 20 AND n_upper * 2 > n_letters"),
    ("duplicate_lines", "n_lines >= 4 AND n_distinct_lines * 10 < n_lines * 7"),
    ("repeated_words", "n_words >= 50 AND n_distinct_words * 10 < n_words"),
    ("no_stop_words", "n_words >= 20 AND n_stop_words < 2"),
    ("bullet_lines", "n_lines >= 4 AND n_bullets * 10 > n_lines * 9"),
    ("ellipsis_lines", "n_lines >= 4 AND n_ellipses * 10 > n_lines * 3"),
    ("code_braces", "n_braces * 50 > n_words AND n_braces > 4"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Policies by version: a document is kept if none of the mask's bits is set.
POLICIES = {
    "v1": mask("too_few_words", "too_many_words", "short_mean_word", "long_mean_word", "few_letters", "many_symbols", "shouting", "bullet_lines", "ellipsis_lines"),
    "v2": sum(BIT.values()),
}

_BULLETS, _ELLIPSES = "(?m)^[ \\t]*[-*•]", "(?m)(\\.\\.\\.|…)[ \\t]*$"


def _spark_measures() -> dict[str, str]:
    quote = lambda s: s.replace("\\", "\\\\")
    stops = "array(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"
    words = {
        "size": "size", "translate": "translate", "replace": "regexp_replace", "distinct": "array_distinct", "intersect": "array_intersect", "stops": stops,
        "bullets": f"regexp_count(t, '{quote(_BULLETS)}')", "ellipses": f"regexp_count(t, '{quote(_ELLIPSES)}')",
    }
    found = {}
    for name, sql in MEASURES.items():
        found[name] = sql.format(**{**words, "replace": "regexp_replace"})
        found[name] = found[name].replace("\\p", "\\\\p") if "\\p" in found[name] else found[name]
    return found


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, fail_bits BIGINT, one BIGINT column per measurement), one row per row of ``docs``.

    A null text is measured as an empty one (it fails ``too_few_words``).
    Words are split at white space, lines at line feeds, and empty words and
    lines don't count. Rows are judged one by one: repeated rows, null ids
    and texts of any length need no special case. Other columns are not read.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), t.alias("t"))
    lowered = F.array_remove(F.split(F.lower("t"), "[ \t\r\n]+"), "")
    rows = rows.select("doc_id", "t", lowered.alias("words"), F.array_remove(F.split("t", "\n"), "").alias("lines"))
    measured = rows.select("doc_id", *[F.expr(sql).cast("bigint").alias(name) for name, sql in _spark_measures().items()])
    bits: Column = F.lit(0).cast("bigint")
    for i, (_, rule) in enumerate(RULES):
        bits = bits + F.when(F.expr(rule), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return measured.select("doc_id", bits.alias("fail_bits"), *MEASURES)


def apply_policy(book: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept_<version>``; reads the bits only."""
    return book.withColumn(f"kept_{version}", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(book: DataFrame, versions: Iterable[str] | None = None) -> DataFrame:
    """(policy, rule, failed, only_failure) for each rule of each policy (or of ``versions``).

    ``failed``: documents with the bit; ``only_failure``: those with no other
    bit of the policy, which the policy would keep without the rule. One pass
    over the bits groups equal masks, so the rest, for all policies, is over at
    most as many rows as masks that occur.
    """
    hits = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = [(v, POLICIES[v], name, bit) for v in versions or POLICIES for name, bit in BIT.items() if bit & POLICIES[v]]
    structs = [F.struct(F.lit(v).alias("policy"), F.lit(m).cast("bigint").alias("mask"), F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for v, m, n, b in rules]
    each = hits.select("fail_bits", "n", F.explode(F.array(*structs)).alias("r")).select("fail_bits", "n", "r.*")
    failed, alone = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("fail_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return each.groupBy("policy", "rule").agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_failure"))


def ablation(book: DataFrame, version: str) -> DataFrame:
    """(rule, failed, only_failure) for each rule of one policy."""
    return ablations(book, [version]).drop("policy")


class Evaluated(NamedTuple):
    """What one evaluation of the rules stores: the ledger, and the ablations of the policies of its time."""

    book: DataFrame
    policies: dict[str, int]
    ablations: DataFrame


_stored: dict[tuple, Evaluated] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """The session, and path, size and time of each file: another state of the table is another ledger."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.sparkContext.applicationId, path, tuple(sorted(found))


def evaluate(spark: SparkSession, sf_dir: str) -> Evaluated:
    """Run the rules over all texts and store the ledger; then aggregate its bits and store the ablations."""
    path = f"{sf_dir}/documents.parquet"
    key = _stamp(spark, path)
    book = materialize(ledger(spark.read.parquet(path)), "ledger")
    _stored[key] = Evaluated(book, dict(POLICIES), materialize(ablations(book), "ablations"))
    return _stored[key]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, evaluated once and stored, with the verdict of each policy.

    The ablations are made of the stored bits in the same run; ``quality_ablation`` returns them.
    """
    book = evaluate(spark, sf_dir).book
    for version in POLICIES:
        book = apply_policy(book, version)
    return book


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy, rule, failed, only_failure) over all documents, as the evaluation stored them.

    Texts are read only if this session has no ledger of the table as it is
    now; policies that changed since are aggregated from the stored bits.
    """
    found = _stored.get(_stamp(spark, f"{sf_dir}/documents.parquet")) or evaluate(spark, sf_dir)
    return found.ablations if found.policies == POLICIES else ablations(found.book)


def ablation_sql() -> str:
    """The same in DuckDB, over the ledger's SQL."""
    rules = ", ".join(f"('{v}', '{name}', {bit}, {m})" for v, m in POLICIES.items() for name, bit in BIT.items() if bit & m)
    return f"""
WITH book AS ({op6_sql()}), rules(policy, rule, bit, m) AS (VALUES {rules})
SELECT policy, rule, CAST(sum(((fail_bits & bit) <> 0)::INT) AS BIGINT) AS failed, CAST(sum(((fail_bits & m) = bit)::INT) AS BIGINT) AS only_failure FROM book, rules GROUP BY ALL"""


def op6_sql() -> str:
    stops = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"
    words = {
        "size": "len", "translate": "translate", "replace": "regexp_replace", "distinct": "list_distinct", "intersect": "list_intersect", "stops": stops,
        "bullets": f"len(regexp_extract_all(t, '{_BULLETS}'))", "ellipses": f"len(regexp_extract_all(t, '{_ELLIPSES}'))",
    }
    sql = {name: s.format(**words) for name, s in MEASURES.items()}
    sql = {name: s.replace(", '')", ", '', 'g')") if "regexp_replace" in s else s for name, s in sql.items()}
    measured = ", ".join(f"CAST({s} AS BIGINT) AS {name}" for name, s in sql.items())
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
    kept = ", ".join(f"(fail_bits & {m}) = 0 AS kept_{v}" for v, m in POLICIES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[ \t\r\n]+'), lambda x: x <> '') AS words, list_filter(string_split(t, E'\\n'), lambda x: x <> '') AS lines FROM d),
m AS (SELECT doc_id, {measured} FROM a),
b AS (SELECT doc_id, CAST({bits} AS BIGINT) AS fail_bits, {', '.join(MEASURES)} FROM m)
SELECT *, {kept} FROM b"""
