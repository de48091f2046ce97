"""Retrieval quality, eval gates, run comparison and tool traces."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.functions.text import norm_id
from metaloom.sql import structure


def ir_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, mrr, ndcg, hit) of each question with relevant entities.

    ``ranked`` has qid, id and rank from 1, ``qrels`` qid, id and grade. Gain is 2^grade - 1,
    discounted by log2(rank + 1); the ideal order has the grades descending.
    """
    rel = qrels.where("id is not null and grade > 0").groupBy("qid", "id").agg(F.max("grade").alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = rel.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("grade"), "id"))).where(F.col("r") <= k)
    ideal = ideal.groupBy("qid").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("idcg"))
    met = rel.join(ranked.where(F.col("rank") <= k), ["qid", "id"], "left")
    got = met.groupBy("qid").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank").isNotNull(), gain / F.log2(F.col("rank") + 1))).alias("dcg"))
    return got.join(ideal, "qid").select(
        "qid", F.round(F.col("found") / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6).alias("ndcg"), (F.col("found") > 0).alias("hit")
    )


def ir_summary(metrics: DataFrame) -> DataFrame:
    mean = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")]
    return metrics.agg(F.count("*").alias("questions"), *mean, F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def relevant(qrels: DataFrame) -> DataFrame:
    """(qid, id, grade) of the graded questions; a repeated question counts once."""
    once = qrels.dropDuplicates(["entry_id"]).select(F.col("entry_id").alias("qid"), F.explode("relevant").alias("x"))
    return once.select("qid", norm_id("x.unique_id").alias("id"), F.col("x.grade").alias("grade"))


def run_pass_rates(results: DataFrame) -> DataFrame:
    """(run_id, at, cases, pass_rate) of each run; results have run_id, at, case_id and status."""
    return results.groupBy("run_id").agg(F.max("at").alias("at"), F.count("*").alias("cases"), F.round(F.avg((F.col("status") == "pass").cast("int")), 6).alias("pass_rate"))


def gate(results: DataFrame, least: float, most_drop: float = 0.02) -> DataFrame:
    """(run_id, pass_rate, previous_rate, status): whether the latest run passes enough, and not much less than the one before."""
    runs = run_pass_rates(results).orderBy(F.desc("at"), F.desc("run_id")).limit(2)
    w = W.orderBy("at", "run_id")
    last = runs.withColumn("previous_rate", F.lag("pass_rate").over(w)).withColumn("r", F.row_number().over(W.orderBy(F.desc("at"), F.desc("run_id")))).where("r = 1")
    bad = (F.col("pass_rate") < least) | F.coalesce(F.col("previous_rate") - F.col("pass_rate") > most_drop, F.lit(False))
    return last.select("run_id", "pass_rate", "previous_rate", F.when(bad, "fail").otherwise("pass").alias("status"))


def compare_runs(results: DataFrame, first: Any, second: Any) -> DataFrame:
    """(case_id, first_status, second_status, change): each case of two runs: fixed, broken, added, removed or same."""
    def one(run, name):
        return results.where(F.col("run_id") == run).groupBy("case_id").agg(F.min("status").alias(name))

    both = one(first, "first_status").join(one(second, "second_status"), "case_id", "full_outer")
    a, b = F.col("first_status"), F.col("second_status")
    change = F.when(a.isNull(), "added").when(b.isNull(), "removed").when((a != "pass") & (b == "pass"), "fixed").when((a == "pass") & (b != "pass"), "broken").otherwise("same")
    return both.select("case_id", "first_status", "second_status", change.alias("change"))


def retain_newest(results: DataFrame, runs: int) -> DataFrame:
    """Results of the newest runs."""
    keep = run_pass_rates(results).orderBy(F.desc("at"), F.desc("run_id")).limit(runs).select("run_id")
    return results.join(keep, "run_id", "left_semi")


def trace_summary(traces: DataFrame) -> DataFrame:
    """(tool, calls, errors, truncated, bytes, first_index) of each tool; traces have tool, call_index, success, truncated and bytes."""
    return traces.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.count_if("truncated").alias("truncated"), F.sum("bytes").alias("bytes"), F.min("call_index").alias("first_index")
    )


def semantic_first(traces: DataFrame) -> DataFrame:
    """(session, verdict): whether search_indicator was called before execute_sql.

    ``traces`` may have a column metric_like: whether the call's query asks for a metric. SQL
    without any search is a warning if some query does, else there is nothing to judge by.
    """
    like = F.coalesce("metric_like", F.lit(False)) if "metric_like" in traces.columns else F.lit(False)
    g = traces.groupBy("session").agg(
        F.min(F.when(F.col("tool") == "search_indicator", F.col("call_index"))).alias("s"), F.min(F.when(F.col("tool") == "execute_sql", F.col("call_index"))).alias("q"), F.max(like).alias("m")
    )
    s, q = F.col("s"), F.col("q")
    verdict = F.when(s.isNull() & q.isNull(), "not_applicable").when(q.isNull(), "observed_without_sql").when(s.isNull() & F.col("m"), "warn").when(s.isNull(), "not_observed").when(s < q, "pass").otherwise("warn")
    return g.select("session", verdict.alias("verdict"))


def latency(traces: DataFrame, value: str, edges: tuple[float, ...] = (1, 5, 10, 50, 100, 500)) -> DataFrame:
    """(tool, calls, p50, p95, le_…): percentiles and cumulative counts of a duration."""
    counts = [F.count_if(F.col(value) <= e).alias(f"le_{e:g}") for e in edges]
    return traces.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), *counts)


#: What may hold a secret in a text or an address.
SECRETS = r"(?i)((?:password|passwd|token|secret|api_?key|authorization)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;&}]+"
ADDRESS = r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^/\s@]+@"


def redact(text: Column) -> Column:
    """The text with the values of secrets and the user part of addresses masked."""
    return F.regexp_replace(F.regexp_replace(text, SECRETS, "$1***"), ADDRESS, "$1***@")


def at_path(value: Any, path: str) -> Any:
    """The part of a record that a dotted path names; numbers are places in lists. None if there is none."""
    for part in path.split("."):
        if isinstance(value, list):
            value = value[int(part)] if part.isdigit() and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def rank_of(hits: list[dict[str, Any]], **wanted: Any) -> int | None:
    """Place from 1 of the first hit that has all the values asked for."""
    asked = {k: v for k, v in wanted.items() if v is not None}
    return next((i for i, h in enumerate(hits, 1) if all(h.get(k) == v for k, v in asked.items())), None)


def assess(assertion: dict[str, Any], run: Callable[[str, dict[str, Any]], Any]) -> tuple[bool, str]:
    """(passed, reason) of one eval assertion; ``run(tool, params)`` gives what the tool answers: a page, so small, or an exception.

    The fifteen types: search_rank, search_indicator_rank, search_columns_rank, context_has,
    context_field_equals, context_contains, metadata_score_min, metadata_score_max,
    recipe_rank, recipe_has_queries, lineage_contains, tool_success, tool_response_budget,
    tool_field_equals, sql_structure. Ranks count from 1; without max_rank any place will do. A tool
    that fails fails its assertion.
    """
    kind = assertion["type"]
    get = assertion.get

    def ranked(tool: str, params: dict[str, Any], **wanted: Any) -> tuple[bool, str]:
        at = rank_of(run(tool, {k: v for k, v in params.items() if v}), **wanted)
        most = get("max_rank")
        return at is not None and (most is None or at <= most), "not found" if at is None else f"rank {at}"

    try:
        if kind == "search_rank":
            return ranked("search", {k: get(k) for k in ("query", "resource_types", "persona")}, unique_id=assertion["expected_unique_id"])
        if kind == "search_indicator_rank":
            return ranked("search_indicator", {k: get(k) for k in ("query", "resource_types", "indicator_types", "persona")}, indicator_name=assertion["expected"])
        if kind == "search_columns_rank":
            return ranked("search_columns", {"query": assertion["query"]}, column_name=get("expected_column"), unique_id=get("expected_parent_unique_id"))
        if kind == "recipe_rank":
            return ranked("search_recipes", {"query": assertion["query"]}, recipe_id=assertion["expected_recipe_id"])
        if kind in ("context_has", "context_field_equals", "context_contains"):
            found = run("get_context", {"id_or_name": assertion["id_or_name"]})
            if kind == "context_has":
                lacks = [f for f in assertion["fields"] if at_path(found, f) is None]
                return not lacks, "lacks " + ", ".join(lacks) if lacks else "has all"
            if kind == "context_field_equals":
                value = at_path(found, assertion["field"])
                return value == assertion["expected"], f"is {value!r}"
            held = json.dumps(at_path(found, get("field")) if get("field") else found, default=str).lower()
            return str(assertion["expected"]).lower() in held, "searched"
        if kind in ("metadata_score_min", "metadata_score_max"):
            score = run("get_metadata_score", {k: get(k) for k in ("id_or_name", "persona") if get(k)})["overall"]
            return score >= assertion["threshold"] if kind.endswith("min") else score <= assertion["threshold"], f"score {score}"
        if kind == "recipe_has_queries":
            n = len(run("get_recipe", {"recipe_id": assertion["recipe_id"]})["queries"])
            return n >= (1 if get("min_queries") is None else get("min_queries")), f"{n} queries"
        if kind == "lineage_contains":
            ids = [n["unique_id"] for n in run("get_lineage", {k: get(k) for k in ("id_or_name", "direction", "depth") if get(k) is not None})]
            return assertion["expected_unique_id"] in ids, f"{len(ids)} nodes"
        if kind == "sql_structure":
            off = [part for part, d in structure.diff(assertion["actual_sql"], assertion["expected_sql"]).items() if d["only_first"] or d["only_second"]]
            return not off, "differs in " + ", ".join(off) if off else "same"
        if kind in ("tool_success", "tool_response_budget", "tool_field_equals"):
            found = run(assertion["tool"], get("params") or {})
            if kind == "tool_success":
                return True, "answered"
            if kind == "tool_field_equals":
                value = at_path(found, assertion["field"])
                return value == assertion["expected"], f"is {value!r}"
            size = len(json.dumps(found, default=str).encode())
            lacks = [p for p in get("must_contain_paths", []) if at_path(found, p) is None] + [p for p in get("must_not_contain_paths", []) if at_path(found, p) is not None]
            return size <= assertion["max_response_bytes"] and not lacks, f"{size} bytes" + (", wrong: " + ", ".join(lacks) if lacks else "")
    except Exception as e:  # noqa: BLE001 - whatever a tool raises is its answer
        return False, f"{type(e).__name__}: {e}"
    raise ValueError(f"unknown assertion {kind}")


def run_suite(cases: list[dict[str, Any]], run: Callable[[str, dict[str, Any]], Any]) -> list[dict[str, Any]]:
    """A row for each assertion of each case (id, assertions), in order: case_id, place, type, status, reason."""
    out = []
    for case in cases:
        for i, assertion in enumerate(case.get("assertions", [])):
            ok, why = assess(assertion, run)
            out.append({"case_id": case["id"], "place": i, "type": assertion["type"], "status": "pass" if ok else "fail", "reason": why})
    return out
