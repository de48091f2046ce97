"""What a statement may do, and how much it may return."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.sql.scan import statements, tokens

#: Limits on results, and the most that a caller may ask for.
ROW_LIMIT, ROW_CAP = 1000, 10_000
BYTE_LIMIT, BYTE_CAP = 25 * 2**20, 100 * 2**20
#: How a read-only statement may begin; what may not stand in it.
READS = {"select", "with", "values", "table", "explain", "("}
WRITES = {
    "insert", "update", "delete", "merge", "create", "drop", "alter", "truncate", "grant", "revoke", "call", "copy", "load", "attach", "detach",
    "install", "set", "reset", "use", "refresh", "cache", "uncache", "msck", "analyze", "vacuum", "optimize", "export", "import", "pragma", "add", "replace",
}
#: Functions and relations that reach beyond the registered tables.
FILE_FORMATS = {"parquet", "csv", "json", "orc", "text", "avro", "delta", "binaryfile", "jdbc"}
UNSAFE_FUNCTIONS = {
    "reflect", "java_method", "try_reflect", "read_csv", "read_csv_auto", "read_parquet", "parquet_scan", "read_json", "read_json_auto", "read_text", "read_blob", "read_files", "glob", "sniff_csv",
}
#: Words that also name functions when a bracket follows.
ALSO_FUNCTIONS = {"replace", "set", "add", "load", "copy"}


class GuardError(ValueError):
    """The statement is not a single read-only query over registered tables."""


def check(sql: str) -> str:
    """The one statement in ``sql``; raises GuardError for anything but a SELECT or EXPLAIN SELECT."""
    found = statements(sql or "")
    if len(found) != 1:
        raise GuardError("exactly one statement is needed")
    items = [(k, t.lower() if k in ("word", "op") else t) for k, t in tokens(found[0])]
    if not items or items[0][1] not in READS:
        raise GuardError("only SELECT, or EXPLAIN of a SELECT, is allowed")
    if items[0][1] == "explain":
        rest = [t for _, t in items[1:] if t not in ("extended", "codegen", "cost", "formatted", "analyze")]
        if not rest or rest[0] not in READS - {"explain"} or any(t == "analyze" for _, t in items[1:3]):
            raise GuardError("only EXPLAIN of a SELECT is allowed")
    depth = 0
    for i, (kind, text) in enumerate(items):
        after = items[i + 1][1] if i + 1 < len(items) else ""
        before = items[i - 1][1] if i else ""
        depth += (text == "(") - (text == ")")
        if kind != "word" and kind != "ident":
            continue
        bare = text.strip('"`').lower()
        if kind == "word" and text in WRITES and before != "." and after != "." and not (after == "(" and text in ALSO_FUNCTIONS):
            starts = i == 0 or before in ("(", ")") or (text in ("insert", "update", "delete", "merge") and after in ("into", "from", "set"))
            if starts:
                raise GuardError(f"{text.upper()} is not allowed")
        if kind == "word" and text == "into" and before != "insert":
            raise GuardError("SELECT INTO is not allowed")
        if after == "(" and bare in UNSAFE_FUNCTIONS:
            raise GuardError(f"function {bare} is not allowed")
        if bare in FILE_FORMATS and after == "." and i + 2 < len(items) and items[i + 2][0] == "ident" and before in ("from", "join", ","):
            raise GuardError("files cannot be queried directly")
        if before in ("from", "join") and kind == "ident" and ("/" in bare or ":" in bare):
            raise GuardError("files cannot be queried directly")
    if depth:
        raise GuardError("brackets don't match")
    return found[0]


def clamp(value: int | None, default: int, cap: int) -> int:
    """A limit of at least 1 and at most ``cap``; ``default`` if none is given."""
    return max(1, min(default if value is None else int(value), cap))


def scalar_args(params: dict[str, Any] | None) -> dict[str, Any]:
    """Parameters of a statement, which are scalars only."""
    for name, value in (params or {}).items():
        if not isinstance(value, (type(None), bool, int, float, str)):
            raise GuardError(f"parameter {name} must be a scalar")
    return dict(params or {})


def execute(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The lazy result of a guarded statement; ``:name`` in it takes the value of ``params``."""
    return spark.sql(check(sql), args=scalar_args(params))


@dataclass
class Page:
    """Rows of a result up to its limits, as JSON objects."""

    columns: list[str]
    types: list[str]
    rows: list[dict]
    truncated: bool


def fetch(df: DataFrame, row_limit: int | None = None, byte_limit: int | None = None) -> Page:
    """The first rows of a result, cut before the row or byte limit is passed.

    At most row_limit + 1 rows leave the cluster; one more than the limit shows that there are more.
    """
    rows, size = clamp(row_limit, ROW_LIMIT, ROW_CAP), clamp(byte_limit, BYTE_LIMIT, BYTE_CAP)
    names = [f"c{i}" for i in range(len(df.columns))]
    out, used = [], 0
    for r in df.toDF(*names).limit(rows + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect():
        used += len(r[0].encode())
        if len(out) == rows or used > size:
            return Page(df.columns, [t for _, t in df.dtypes], out, True)
        held = json.loads(r[0])
        out.append([held[n] for n in names])
    return Page(df.columns, [t for _, t in df.dtypes], out, False)


def within_bytes(df: DataFrame, order: list, byte_limit: int) -> DataFrame:
    """Rows, in order, whose running size as JSON stays within ``byte_limit``: a page's limit, for a result that is already small."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    running = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("_bytes", running).where(F.col("_bytes") <= byte_limit).drop("_bytes")


def preflight(spark: SparkSession, relation: str | None = None) -> list[tuple[str, str]]:
    """(check, status) of connectivity, catalog, schema and relation; ``ok``, or why not."""
    out = [("connectivity", "ok" if spark.sql("SELECT 1").first()[0] == 1 else "failed"), ("catalog", spark.catalog.currentCatalog() and "ok")]
    out.append(("schema", "ok" if spark.catalog.databaseExists(spark.catalog.currentDatabase()) else "missing"))
    if relation is not None:
        out.append(("relation", "ok" if spark.catalog.tableExists(relation) else "missing"))
    return out
