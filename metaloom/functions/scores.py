"""Scalar functions on texts, tiers and grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(col: Column | str, least_bytes: int = 2) -> Column:
    """Words of letters and digits in lower case, of at least so many bytes, repeats kept."""
    col = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= least_bytes)


def has_query_syntax(col: Column) -> Column:
    """Whether a search text uses operators: quotes, fields, groups, wildcards, AND, OR, NOT or a leading minus."""
    return col.rlike(r"""["':()*~+\[\]{}]| AND | OR | NOT | -""")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """How many of a's tokens, repeats counted, are among b's."""
    return F.size(F.filter(a, lambda t: F.array_contains(b, t)))


def fully_covered(a: Column, b: Column) -> Column:
    """Number of a's tokens if all are among b's, else 0."""
    return F.when(F.forall(a, lambda t: F.array_contains(b, t)), F.size(a)).otherwise(0)


def phrase_contains(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text between blanks or ends; any occurrence counts."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def description_tier(text: Column, most: int) -> Column:
    """Points for a description by its trimmed length in bytes."""
    n = F.octet_length(F.trim(F.coalesce(text, F.lit(""))))
    share = F.when(n == 0, 0.0).when(n < 20, 0.2).when(n < 50, 0.5).when(n < 100, 0.8).otherwise(1.0)
    return F.round(share * most).cast("int")


def array_tier(n: Column, most: int) -> Column:
    """Points for the length of a list."""
    share = F.when(n <= 0, 0.0).when(n == 1, 0.4).when(n == 2, 0.7).otherwise(1.0)
    return F.round(share * most).cast("int")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def clamped(value: Column, most: int) -> Column:
    """A value between 0 and ``most``, rounded half away from zero."""
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(float(most)))).cast("int")


def percent(part: Column, whole: Column, expected: bool) -> Column:
    """Whole percent of a part; of nothing it is 0 where something is expected, else 100."""
    return F.when(whole == 0, 0 if expected else 100).otherwise(clamped(part / F.nullif(whole, F.lit(0)) * 100, 100)).cast("int")


#: Parts of a declared type's name that tell its family.
NUMERIC = "int|num|dec|float|double|real|money|serial"
TEXTUAL = "char|text|string|varchar|clob"
TEMPORAL = "date|time|timestamp|interval"


def type_family(col: Column) -> Column:
    low = F.lower(col)
    return F.when(low.rlike(TEMPORAL), "temporal").when(low.rlike(NUMERIC), "numeric").when(low.rlike(TEXTUAL), "string")


def types_compatible(a: Column, b: Column) -> Column:
    """Equal types, types of one family, or either unknown."""
    blank = F.coalesce(a, F.lit("")) == ""
    other = F.coalesce(b, F.lit("")) == ""
    return blank | other | (F.lower(a) == F.lower(b)) | F.coalesce(type_family(a) == type_family(b), F.lit(False))


#: Words of a column's name that hint at personal data.
PII_WORDS = ("email", "phone", "address", "full_name", "first_name", "last_name", "date_of_birth")


def pii_like(name: Column) -> Column:
    """Whether one of these stands between underscores or ends; blanks and hyphens count as underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), "[- ]", "_").rlike("(^|_)(" + "|".join(PII_WORDS) + ")(_|$)")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path pattern: ``**`` any text, ``*`` any but a slash, ``?`` one such character."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        c = pattern[i]
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r"\.^$|()[]{}+" else c)
        i += 1
    return "^" + "".join(out) + "$"


def glob_prefix(pattern: str) -> str:
    """The text before the first wildcard, which a scan can prune by."""
    return pattern[: min([i for i in (pattern.find("*"), pattern.find("?")) if i >= 0], default=len(pattern))]
