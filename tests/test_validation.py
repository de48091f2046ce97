"""Each rule of a semantic block on a block that breaks it, and a sound block that breaks none."""

from __future__ import annotations

import json

from metaloom.operators.validation import SEVERITY, block_rules, validate_blocks

GOOD = {
    "columns": {"id": {}, "day": {}, "amount": {}},
    "meta": {"nova": {"canonical": True, "synonyms": ["a", "b"], "grain": {"primary_key": ["id"], "time_field": "day", "dimensions": []}, "measures": [{"name": "m", "field": "amount", "expression": "sum(amount)", "description": "d"}],
                      "metrics": [{"name": "k", "template": True, "expression": "e", "grain": {"primary_key": "id"}, "recommended_filters": [{"field": "day", "operator": "between", "values": [1, 2]}]}]}},
}


def broken(**block):
    return {code for code, _ in block_rules({"columns": GOOD["columns"], "meta": {"nova": block}})}


def test_a_sound_block():
    assert list(block_rules(GOOD)) == [] and list(block_rules({"meta": {}})) == []


def test_every_rule(spark):
    metric = {"name": "k", "template": True, "expression": "e", "grain": {}}
    cases = {
        "schema_violation": {"measures": "text"}, "metric_and_metrics_conflict": {"metric": metric, "metrics": []}, "duplicate_measure_name": {"measures": [{"name": "A"}, {"name": "a "}]}, "duplicate_metric_name": {"metrics": [metric, metric]},
        "duplicate_semantic_name": {"measures": [{"name": "K"}], "metrics": [metric]}, "duplicate_primary_key": {"grain": {"primary_key": ["id", "ID"]}}, "duplicate_dimension": {"grain": {"dimensions": ["id", "id"]}},
        "grain_field_overlap": {"grain": {"primary_key": ["id"], "dimensions": ["id"]}}, "measure_missing_expression": {"measures": [{"name": "m", "field": "id"}]}, "measure_missing_description": {"measures": [{"name": "m"}]},
        "metric_missing_grain": {"metric": {"name": "k"}}, "metric_missing_template": {"metric": {"name": "k"}}, "metric_missing_expression": {"metric": {"name": "k"}}, "empty_recommended_filters": {"metric": {**metric, "recommended_filters": []}},
        "unsupported_filter_operator": {"metric": {**metric, "recommended_filters": [{"field": "id", "operator": "like"}]}}, "invalid_filter_values": {"metric": {**metric, "recommended_filters": [{"field": "id", "operator": "between", "values": [1]}]}},
        "blank_operator": {"metric": {**metric, "recommended_filters": [{"field": "id"}]}}, "blank_string": {"measures": [{"name": " "}]}, "blank_array_value": {"domains": [" "]}, "empty_array": {"use_cases": []}, "duplicate_array_value": {"synonyms": ["a", "A"]},
        "missing_referenced_field": {"grain": {"time_field": "nowhere"}}, "canonical_analyst_deboost_conflict": {"canonical": True, "search": {"candidates": {"analyst": False}}},
    }
    for code, block in cases.items():
        assert code in broken(**block), code
    claim = {"name": "rate", "canonical": True}
    rows = [(1, "a", json.dumps({"meta": {"nova": {"metrics": [claim, {**claim, "name": "RATE"}]}}})), (2, "b", json.dumps({"meta": {"nova": {"metric": claim}}})), (2, "b", json.dumps({"meta": {"nova": {"metric": claim}}})), (3, "c", "{"), (4, "c", None), (5, None, "[]")]
    df = spark.createDataFrame(rows, "block_id long, unique_id string, payload_json string")
    got = validate_blocks(df).collect()
    assert {(r.block_id, r.code) for r in got if "canonical" in r.code} == {(1, "canonical_indicator_conflict"), (2, "canonical_indicator_conflict"), (1, "duplicate_canonical_surface")}
    assert sum(r.block_id == 2 and r.code == "metric_missing_grain" for r in got) == 1 and all(r.severity == SEVERITY[r.code] for r in got)
    assert set(cases) | {"duplicate_canonical_surface", "canonical_indicator_conflict"} == set(SEVERITY)
    assert validate_blocks(df.limit(0)).count() == 0
