"""Scores, gaps and summaries: values worked out by hand, and dirty payloads."""

from __future__ import annotations

import json
from datetime import datetime

from metaloom.operators import context, inventory, scoring
from metaloom.operators.payloads import column_tests, payload_facts

ENTITY = "unique_id string, resource_type string, entity_name string, package_name string, materialization string, description string, tags array<string>, created_at timestamp_ntz"
T = datetime(2024, 1, 1)


def setup(spark, entities, payloads, tests=()):
    e = spark.createDataFrame([(u, t, n, "p", "table", d, ["x"], T) for u, t, n, d in entities], ENTITY)
    b = spark.createDataFrame([(i, u, T, p if isinstance(p, str) or p is None else json.dumps(p), "clash") for i, (u, p) in enumerate(payloads)], "block_id long, unique_id string, captured_at timestamp_ntz, payload_json string, owner string")
    attached = spark.createDataFrame(list(tests), "unique_id string, test_id string")
    return e, payload_facts(b), inventory.test_coverage(e, attached), column_tests(e, attached), attached


def test_a_short_description_and_one_short_column(spark):
    """18 letters are a fifth of 30 points, 2 letters a fifth of 40: 14 of 85, at 15 percent 2.47, so 2 overall."""
    e, f, cov, tested, _ = setup(spark, [("m.o", "model", "fct__orders", None)], [("M.O ", {"description": "d" * 18, "columns": {"id": {"description": "id"}}})])
    r = scoring.entity_scores(e, f, cov, tested, "governance").first()
    assert (r.documentation, r.semantic, r.governance, r.quality, r.overall, r.grade) == (14, 0, 0, 0, 2, "F")


def test_full_marks_and_what_each_point_is_for(spark):
    column = {"description": "c" * 100, "data_type": "int", "constraints": [{"type": "unique"}, {"type": "not_null"}, {"type": "foreign_key"}], "meta": {"owner": "o", "primary_key": True, "nova": {"role": "identifier", "semantic_type": "key", "synonyms": ["a", "b", "c"], "governance": {"sensitivity": "low", "pii": False, "compliance": ["x", "y", "z"]}}}}
    dim = {**column, "meta": {"owner": "o", "nova": {**column["meta"]["nova"], "role": "dimension"}}}
    nova = {"synonyms": ["1", "2", "3"], "domains": ["1", "2", "3"], "use_cases": ["1", "2", "3"], "grain": {"primary_key": ["id"]}, "measures": [{"name": "m", "expression": "e", "synonyms": ["s"]}], "metrics": [{"name": "k", "expression": "e", "synonyms": ["s"]}], "governance": {"sensitivity": "low", "pii": True, "compliance": ["a", "b", "c"]}}
    tests = [("m.x", f"test.p.{k}_x_{c}.1") for k in ("unique", "not_null") for c in ("id", "kind")]
    e, f, cov, tested, _ = setup(spark, [("m.x", "model", "x", "d" * 100)], [("m.x", {"meta": {"owner": "me", "nova": nova}, "columns": {"id": column, "kind": dim}})], tests)
    r = scoring.entity_scores(e, f, cov, tested).first()
    # The parts of the semantic score add up to more than the maximum it is a share of.
    assert (r.documentation, r.semantic, r.governance, r.quality, r.overall, r.grade) == (85, 110, 100, 70, 97, "A")
    c = {r.column_name: r for r in scoring.column_scores(f, tested).collect()}
    assert (c["id"].documentation, c["id"].semantic, c["id"].governance, c["id"].quality, c["id"].overall) == (100, 100, 100, 100, 100)
    assert scoring.coverage_gaps(f, tested).count() == 0
    gate = scoring.governance_gate(scoring.entity_scores(e, f, cov, tested), e, f, cov).first()
    assert (gate.reasons, gate.gate) == ("", "pass")


def test_gaps_of_a_key_without_tests(spark):
    """Two columns, two generic tests on one, the other being the key: two high gaps and one low."""
    tests = [("m.s", "test.p.unique_stg__traffic_sessions_session.1"), ("m.s", "test.p.not_null_stg__traffic_sessions_session.2")]
    _, f, _, tested, _ = setup(spark, [("m.s", "model", "stg__traffic_sessions", None)], [("m.s", {"columns": {"session": {}, "id": {"meta": {"primary_key": "true"}}}})], tests)
    assert sorted((r.gap, r.severity, r.column_name) for r in scoring.coverage_gaps(f, tested).collect()) == [("missing_not_null_test", "high", "id"), ("missing_unique_test", "high", "id"), ("untested_column", "low", "id")]
    _, f, _, tested, _ = setup(spark, [("m.s", "model", "s", None)], [("m.s", {"columns": {f"c{i}": {} for i in range(6)}})])
    assert [(r.gap, r.columns) for r in scoring.coverage_gaps(f, tested).collect()] == [("many_untested_columns", 6)]


def test_dirty_payloads_say_nothing_and_crash_nothing(spark):
    bad = [("m.a", "{"), ("m.b", None), ("m.c", "[1]"), ("m.d", {"columns": [1], "meta": 3, "config": None}), ("m.e", {"meta": {"nova": {"measures": 5, "metrics": "x", "metric": [1], "grain": [], "governance": "g"}, "owner": " "}, "columns": {"c": None, "d": {"meta": [], "constraints": 3}}}), (None, {}), (" ", {})]
    entities = [(u, "model", None, None) for u, _ in bad if u and u.strip()]
    e, f, cov, tested, attached = setup(spark, entities, bad)
    assert {r.unique_id for r in f.collect()} == {"m.d", "m.e"}
    assert {(r.documentation, r.semantic, r.governance, r.quality) for r in scoring.entity_scores(e, f, cov, tested).collect()} == {(0, 0, 0, 0)}
    none = spark.createDataFrame([], "unique_id string, n_children long")
    assert scoring.engineer_summary(e, f, cov, tested, none).count() == scoring.analyst_summary(e, f).count() == scoring.provenance(e, f, cov, tested, "2024-03-01").count() == 5
    held = context.sections(e, f, attached)
    pairs = spark.createDataFrame([("m.d", "m.e"), ("m.d", "m.e"), ("m.d", "gone")], "first_id string, second_id string")
    diff = {r.section: (r.only_first, r.only_second, r.both) for r in context.diff_entities(pairs, held).collect()}
    assert set(diff) == set(context.SECTIONS) and diff["columns"] == ("", "d", "") and diff["tags"] == ("", "", "x")
    edges, docs = spark.createDataFrame([("m.d", f"up{i}") for i in range(9)], "child string, parent string"), spark.createDataFrame([(7, " M.D"), (7, "m.d"), (8, None)], "doc_id long, unique_id string")
    got = {r.unique_id: r for r in context.contexts(e, f, edges, attached, docs).collect()}
    assert len(got) == 5 and got["m.d"].n_upstream == 9 and got["m.d"].upstream == "up0,up1,up2,up3,up4" and got["m.d"].n_documents == 1 and got["m.a"].upstream == ""
    assert scoring.entity_scores(e.limit(0), f, cov, tested).count() == 0 and context.contexts(e, f.limit(0), edges.limit(0), attached, docs.limit(0)).count() == 5
