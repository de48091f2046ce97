"""Saved multi-query recipes with placeholders."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.scores import tokens
from metaloom.operators.search import FIELD_BOOSTS, bm25, top
from metaloom.sql.guard import GuardError, execute

PLACEHOLDER = re.compile(r"__([A-Za-z][A-Za-z0-9_]*?)__")
TEMPLATING = re.compile(r"\{\{|\{%|\{#")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)*")
LAST = 2**31 - 1


@dataclass(frozen=True)
class Parameter:
    """kind: identifier, number, boolean, raw (digits and words only) or string, which is quoted."""

    kind: str = "string"
    required: bool = True
    default: Any = None


def query_number(name: str) -> int:
    """The number at the end of a query's name after one or two underscores; those without come last."""
    found = re.search(r"_{1,2}(\d+)$", name.rsplit(".", 1)[0])
    return int(found[1]) if found else LAST


def literal(value: Any, p: Parameter, quoted: bool = False) -> str:
    """The text that stands for a value; what could end the literal or name is rejected or escaped."""
    if p.kind == "identifier":
        if not IDENTIFIER.fullmatch(str(value)):
            raise GuardError(f"{value!r} is no identifier")
        return str(value)
    if p.kind == "number":
        text = str(value)
        if isinstance(value, bool) or not re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", text):
            raise GuardError(f"{value!r} is no number")
        return text
    if p.kind == "boolean":
        text = str(value).strip().lower()
        if text not in ("true", "false"):
            raise GuardError(f"{value!r} is no boolean")
        return text
    if p.kind == "raw":
        if not re.fullmatch(r"[\w .,:+-]*", str(value)):
            raise GuardError(f"{value!r} cannot stand unquoted")
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "''")
    return text if quoted else f"'{text}'"


def render(sql: str, values: dict[str, Any], parameters: dict[str, Parameter] | None = None) -> str:
    """A query with its placeholders replaced; a placeholder inside quotes takes the value without quotes of its own."""
    if TEMPLATING.search(sql):
        raise GuardError("templating cannot be run")
    known = {k.lower(): v for k, v in (parameters or {}).items()}
    given = {k.lower(): v for k, v in values.items()}

    def one(m: re.Match, quoted: bool) -> str:
        name = m[1].lower()
        p = known.get(name, Parameter())
        value = given.get(name, p.default)
        if value is None:
            if p.required:
                raise GuardError(f"parameter {name} is missing")
            return "NULL"
        return literal(value, p, quoted)

    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'", sql):
        out.append(PLACEHOLDER.sub(lambda x: one(x, False), sql[at : m.start()]))
        out.append(PLACEHOLDER.sub(lambda x: one(x, True), m[0]))
        at = m.end()
    return "".join(out) + PLACEHOLDER.sub(lambda x: one(x, False), sql[at:])


def recipes(analyses: DataFrame) -> DataFrame:
    """(recipe, query_name, query_number, sql) from analysis files (path, raw_sql, compiled_sql): a directory below ``recipes`` is a recipe.

    Compiled SQL is taken where there is some. Files outside such a directory are none.
    """
    name = F.regexp_extract("path", r"(?:^|/)recipes/(.+)/[^/]+\.sql$", 1)
    file = F.regexp_extract("path", r"([^/]+)\.sql$", 1)
    number = F.regexp_extract(file, r"_{1,2}(\d+)$", 1)
    return analyses.where(name != "").select(
        name.alias("recipe"), file.alias("query_name"), F.when(number == "", LAST).otherwise(number.try_cast("int")).alias("query_number"), F.coalesce("compiled_sql", "raw_sql").alias("sql")
    )


def search_recipes(found: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(recipe, queries, score, rank): the k recipes that fit a question best, by words of their name, their queries' names and their SQL.

    ``found`` is what :func:`recipes` gives. A recipe's queries are put together first, in
    their order; a question without words finds nothing.
    """
    listed = F.array_sort(F.collect_list(F.struct("query_number", "query_name", "sql")))
    whole = found.groupBy("recipe").agg(listed.alias("q")).select("recipe", F.size("q").alias("queries"), F.array_join("q.query_name", " ").alias("names"), F.array_join("q.sql", " ").alias("code"))
    fields = {"name": F.regexp_replace("recipe", "[_/]", " "), "description": F.regexp_replace("names", "_", " "), "code": F.regexp_replace("code", "_", " ")}
    asked = found.sparkSession.range(1).select(F.lit(1).alias("qid"), F.explode(F.array_distinct(tokens(F.regexp_replace(F.lit(query), "_", " ")))).alias("term"))
    hits = top(bm25(whole, "recipe", fields, asked, FIELD_BOOSTS), k)
    return hits.join(whole.select(F.col("recipe").alias("id"), "queries"), "id").select(F.col("id").alias("recipe"), "queries", "score", "rank")


def run_recipe(spark: SparkSession, queries: list[tuple[str, str]], values: dict[str, Any], parameters: dict[str, Parameter] | None = None, stop: bool = True) -> list[tuple[str, DataFrame | None, str]]:
    """(query, result, error) of each query in order of number, then name; after an error the rest is skipped if ``stop``."""
    out: list[tuple[str, DataFrame | None, str]] = []
    for name, sql in sorted(queries, key=lambda q: (query_number(q[0]), q[0])):
        try:
            out.append((name, execute(spark, render(sql, values, parameters)), ""))
        except Exception as e:  # a failing query is part of the result
            out.append((name, None, str(e).splitlines()[0]))
            if stop:
                break
    return out
