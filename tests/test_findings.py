"""Every finding code on a small project made to have it, and a clean one that has none."""

from __future__ import annotations

import json
from datetime import datetime

from metaloom.operators.modelling import FINDINGS, findings
from metaloom.operators.payloads import columns_of, payload_facts

ENTITY = "unique_id string, resource_type string, entity_name string, package_name string, materialization string, description string, tags array<string>, created_at timestamp_ntz"
GRAIN = {"primary_key": ["id"], "time_field": "day", "dimensions": []}


def setup(spark, entities, blocks, edges):
    e = spark.createDataFrame([(u, t, n, "p", m, "text", [], datetime(2024, 1, 1)) for u, t, n, m in entities], ENTITY)
    b = spark.createDataFrame([(i, u, datetime(2024, 1, 1), p if isinstance(p, str) else json.dumps(p), "clash") for i, (u, p) in enumerate(blocks)], "block_id long, unique_id string, captured_at timestamp_ntz, payload_json string, role string")
    return e, payload_facts(b), spark.createDataFrame(edges, "child string, parent string")


def nova(columns=None, more=None, **block):
    return {"meta": {"nova": block}, "columns": {c: ({} if v is None else v) for c, v in (columns or {}).items()}, **(more or {})}


def test_every_code(spark):
    entities = [
        ("a", "model", "mart_a", "table"), ("b", "model", "mart_b", "table"), ("c", "model", "stg_c", "table"), ("eph", "model", "mart_e", "ephemeral"), ("sm", "semantic_model", "sm", None), ("met", "metric", "met", None), ("src", "source", "src", None),
        ("f1", "model", "fct_one", "table"), ("f2", "model", "fct_two", "table"), ("wide", "model", "mart_w", "table"), ("d1", "model", "mart_d1", "table"), ("d2", "model", "mart_d2", "table"),
    ]
    semantic = {"meta": {"nova": {"semantic_type": "money", "role": "measure"}}}
    blocks = [
        ("a", nova({"revenue": None, "id": None, "customer_email": None, "amount": semantic, "extra_total": {"data_type": "numeric", "catalog_drift": {"catalog_only": True}}, "old": {"catalog_drift": {"type_mismatch": True}}, "gone": {"catalog_drift": {"missing_in_catalog": True}}},
                   canonical=True, metrics=[{"name": "revenue", "canonical": True, "grain": GRAIN}, {"name": "refund_rate", "grain": {"primary_key": ["nowhere"], "time_field": "t"}}, {"name": "no time"}], measures=[{"name": "m1", "field": "old"}, {"name": "m2", "field": "gone", "synonyms": ["Taken"]}])),
        ("b", nova({"amount": {"meta": {"nova": {"semantic_type": "money", "role": "dimension"}}}}, canonical=True, metrics=[{"name": "Revenue", "canonical": True, "grain": {**GRAIN, "time_field": "week"}}, {"name": "taken"}])),
        ("c", nova({"amount": {"meta": {"nova": {"semantic_type": "count"}}}}, measures=[{"name": "raw", "canonical": True}])), ("eph", nova(metrics=[{"name": "a_per_b"}])), ("sm", nova(measures=[{"name": "known"}])),
        ("met", {"type_params": {"measure": {"name": "unknown"}, "numerator": "known"}}), ("f1", nova(grain={"primary_key": ["x"]})), ("f2", nova(grain={"primary_key": ["y"]})), ("d1", nova(measures=[{"name": "same"}], governance={"pii": False})), ("d2", nova(measures=[{"name": " SAME"}], governance={})),
        ("wide", "no json"),
    ]
    blocks.append(("canon", nova(canonical=True)))
    entities.append(("canon", "model", "mart_c", "table"))
    edges = [("a", "f1"), ("a", "f2"), ("b", "src"), *[("wide", f"x{i}") for i in range(7)]]
    got = findings(*setup(spark, entities, blocks, edges)).collect()
    by = {}
    for r in got:
        by.setdefault(r.code, []).append((r.entity, r.severity, r.indicator, r.evidence))
        assert r.category == FINDINGS[r.code] and r.package_name == "p"
    assert set(by) == set(FINDINGS), set(FINDINGS) - set(by)
    assert by["duplicate_canonical_indicator"] == [("a", "blocker", "revenue", "2")] and by["duplicate_indicator_without_canonical_parent"] == [("d1", "medium", "same", "2")]
    assert by["semantic_metric_unresolved_measure_ref"] == [("met", "high", None, "unknown")] and by["agent_surface_too_many_parents"] == [("wide", "medium", None, "7")]
    assert by["multi_fact_metric_model"] == [("a", "high", None, "2")] and by["cross_grain_kpi_without_semantic_artifact"] == [("a", "high", "refund_rate", None)]
    assert by["pii_like_column_without_governance"] == [("a", "medium", None, "customer_email")] and by["canonical_entity_missing_primary_key"][0][0] in ("b", "canon")
    assert by["semantic_label_collision"] == [("a", "high", "taken", "2")] and by["column_semantic_role_conflict"] == [("a", "medium", None, "money")]
    assert by["catalog_missing_indicator_field"] == [("a", "high", "m2", "gone")] and by["helper_ranked_as_analyst_candidate"] == [("c", "low", None, "staging")]


def test_a_clean_project_has_none(spark):
    entities = [("m", "model", "mart_m", "table"), ("s", "source", "s", None)]
    blocks = [("m", nova({"revenue": None, "id": None, "day": None}, grain=GRAIN, governance={"pii": False}, metrics=[{"name": "revenue", "grain": GRAIN}])), ("s", nova(governance={"pii": False}))]
    e, f, edges = setup(spark, entities, blocks, [("m", "x")])
    assert findings(e, f, edges).collect() == []
    assert {r.column_name for r in columns_of(f).collect()} == {"revenue", "id", "day"}
    assert findings(e.limit(0), f.limit(0), edges.limit(0)).count() == 0
