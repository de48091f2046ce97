"""Evaluation metrics by hand, assertions, and streams against the batch."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from metaloom.operators import evals, search
from metaloom.queries import quality
from metaloom.streaming import traces


def test_ir_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1)], "qid int, id string, rank int")
    rel = spark.createDataFrame([(1, "b", 3.0), (1, "q", 1.0), (2, "y", 1.0), (1, "b", 3.0), (3, None, 1.0)], "qid int, id string, grade double")
    got = {r.qid: r for r in evals.ir_metrics(ranked, rel).collect()}
    import math

    dcg, ideal = 7 / math.log2(3), 7 + 1 / math.log2(3)
    assert (got[1].recall, got[1].mrr, got[1].ndcg, got[1].hit) == (0.5, 0.5, pytest.approx(dcg / ideal, abs=1e-6), True)
    assert (got[2].recall, got[2].mrr, got[2].ndcg, got[2].hit) == (0.0, 0.0, 0.0, False) and set(got) == {1, 2}


def test_every_assertion_type():
    answers = {
        "search": [{"unique_id": "a"}, {"unique_id": "b"}], "search_indicator": [{"indicator_name": "rate"}], "search_columns": [{"unique_id": "a", "column_name": "x"}, {"unique_id": "b", "column_name": "x"}], "search_recipes": [{"recipe_id": "r"}],
        "get_context": {"entity": {"name": "Orders", "tags": ["t1"]}, "docs": None}, "get_metadata_score": {"overall": 61}, "get_recipe": {"queries": ["q1", "q2"]}, "get_lineage": [{"unique_id": "up"}], "ping": {"ok": True, "list": [1, {"a": 2}]},
    }

    def run(tool, params):
        if tool == "broken":
            raise RuntimeError("down")
        return answers[tool]

    yes = [
        {"type": "search_rank", "query": "q", "expected_unique_id": "b", "max_rank": 2}, {"type": "search_indicator_rank", "query": "q", "expected": "rate"}, {"type": "search_columns_rank", "query": "q", "expected_column": "x", "expected_parent_unique_id": "b", "max_rank": 2},
        {"type": "context_has", "id_or_name": "a", "fields": ["entity.name", "entity.tags.0"]}, {"type": "context_field_equals", "id_or_name": "a", "field": "entity.name", "expected": "Orders"}, {"type": "context_contains", "id_or_name": "a", "expected": "orders"},
        {"type": "metadata_score_min", "threshold": 61}, {"type": "metadata_score_max", "threshold": 61}, {"type": "recipe_rank", "query": "q", "expected_recipe_id": "r", "max_rank": 1}, {"type": "recipe_has_queries", "recipe_id": "r", "min_queries": 2},
        {"type": "lineage_contains", "id_or_name": "a", "direction": "upstream", "expected_unique_id": "up"}, {"type": "tool_success", "tool": "ping"}, {"type": "tool_response_budget", "tool": "ping", "max_response_bytes": 99, "must_contain_paths": ["list.1.a"], "must_not_contain_paths": ["error"]},
        {"type": "tool_field_equals", "tool": "ping", "field": "list.1.a", "expected": 2}, {"type": "sql_structure", "actual_sql": "select a from t where x between 1 and 2 and y = 3", "expected_sql": "SELECT a FROM t WHERE y = 3 AND x BETWEEN 1 AND 2"},
    ]
    no = [
        {"type": "search_rank", "query": "q", "expected_unique_id": "b", "max_rank": 1}, {"type": "search_rank", "query": "q", "expected_unique_id": "z"}, {"type": "search_columns_rank", "query": "q", "expected_column": "x", "expected_parent_unique_id": "c"},
        {"type": "context_has", "id_or_name": "a", "fields": ["docs"]}, {"type": "metadata_score_min", "threshold": 62}, {"type": "recipe_has_queries", "recipe_id": "r", "min_queries": 3}, {"type": "tool_success", "tool": "broken"}, {"type": "tool_response_budget", "tool": "ping", "max_response_bytes": 5},
        {"type": "tool_response_budget", "tool": "ping", "max_response_bytes": 99, "must_contain_paths": ["none"]}, {"type": "sql_structure", "actual_sql": "select a from t", "expected_sql": "select a from u"},
    ]
    assert len({a["type"] for a in yes}) == 15
    got = evals.run_suite([{"id": "y", "assertions": yes}, {"id": "n", "assertions": no}, {"id": "empty"}], run)
    assert [r["status"] for r in got] == ["pass"] * 15 + ["fail"] * len(no) and [r["place"] for r in got][:3] == [0, 1, 2]
    assert next(r for r in got if r["type"] == "tool_success" and r["case_id"] == "n")["reason"] == "RuntimeError: down"
    with pytest.raises(ValueError):
        evals.assess({"type": "?"}, run)


def test_redaction(spark):
    line = 'postgres://me:pw@host/db?token=abc&x=1 {"api_key": "k-1", "n": 2}'
    assert spark.range(1).select(evals.redact(F.lit(line))).first()[0] == 'postgres://***@host/db?token=***&x=1 {"api_key": "***", "n": 2}'


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [{"at": (t0 + timedelta(minutes=17 * i)).isoformat(), "tool": "ab"[i % 2], "session": "s", "call_index": i, "duration": float(i), "success": i % 5 > 0, "bytes": 1, "truncated": False} for i in range(200)]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        (src / f"{k}.json").write_text("\n".join([json.dumps(r) for r in rows[k * 50 : (k + 1) * 50]] + ["no json"]))
        # Files arrive in order of their times; equal ones would come in any order, and be late.
        os.utime(src / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)
    traces.append_windows(traces.tool_windows(traces.read_traces(spark, str(src), 1)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: {(r.start, r.tool): (r.calls, r.errors, r.mean_duration) for r in df.collect()}
    got, want = key(spark.read.parquet(str(tmp_path / "out"))), key(traces.tool_windows(spark.read.schema(traces.TRACE).json(str(src)).where("at is not null")))
    assert got and all(want[k] == v for k, v in got.items())
    closed = max(k[0] for k in want) - timedelta(hours=3)
    assert {k for k in want if k[0] < closed} <= set(got)


def test_rebuild_on_arrival(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("{}")
    seen = []
    for _ in range(2):
        traces.rebuild_on_arrival(spark, str(src), str(tmp_path / "cp"), lambda df: seen.append(df.count())).awaitTermination()
        (src / "b.json").write_text("[]")
    assert sum(seen) == 2


def test_ir_metrics_ranks_questions_with_the_same_known_words_once(spark, tmp_path, monkeypatch):
    columns = "unique_id string, resource_type string, entity_name string, package_name string, database_name string, schema_name string, materialization string, description string, tags array<string>, created_at timestamp_ntz, deleted_at timestamp_ntz"
    spark.createDataFrame([("m.a", "model", "invoice_total", "p", None, None, None, None, None, None, None)], columns).write.parquet(str(tmp_path / "entities.parquet"))
    asked = [(i, f"invoice unknown{i}", [{"unique_id": "m.a" if i % 2 else "m.b", "grade": 2.0}]) for i in range(40)]
    spark.createDataFrame(asked, "entry_id long, query string, relevant array<struct<unique_id:string,grade:double>>").write.parquet(str(tmp_path / "search_eval_qrels.parquet"))
    ranked = []
    kept = search.bulk_top
    monkeypatch.setattr(search, "bulk_top", lambda *a: ranked.append(kept(*a, block=4)) or ranked[-1])
    assert quality.ir_metrics(spark, str(tmp_path)).collect()[0].asDict() == {"questions": 40, "recall": 0.5, "mrr": 0.5, "ndcg": 0.5, "hit_rate": 0.5}
    assert ranked[0]._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
