"""Child records of semantic blocks, case by case and against a plain reading."""

from __future__ import annotations

import json

from metaloom.operators.nested import SEMANTIC_BLOCK, ShapeAutomaton, child_records, flatten, subtype_tables

SCHEMA = "block_id long, unique_id string, captured_at timestamp_ntz, payload_json string, value string"


def run(spark, payloads):
    df = spark.createDataFrame([(i, "u", None, p if isinstance(p, str) or p is None else json.dumps(p), "clash") for i, p in payloads], SCHEMA)
    return child_records(df)


def keys(df):
    return sorted((r.block_id, r.child_kind, r.pos_a, r.pos_b, r.pos_c) for r in df.collect())


def test_positions_and_wrong_types(spark):
    block = {
        "measures": [None, {"name": "m", "synonyms": ["a", None, 3, True, ["x"], "b"]}, {"name": 5}, "text", {"name": "n", "synonyms": "lone"}],
        "metric": 7,
        "metrics": [{"name": "k", "synonyms": [], "grain": {"primary_key": "id", "dimensions": [1.5, {}, "d"]}, "recommended_filters": [None, {"field": "f", "values": 4}, {"field": None, "values": [1]}, {"field": "g", "values": ["x", False, "y"]}]}],
        "grain": {"primary_key": ["not of a metric"]},
    }
    want = [
        (1, "filter", 1, 1, -1), (1, "filter", 1, 3, -1), (1, "filter_value", 1, 1, 0), (1, "filter_value", 1, 3, 0), (1, "filter_value", 1, 3, 2), (1, "grain_dimension", 1, 0, -1), (1, "grain_dimension", 1, 2, -1),
        (1, "grain_key", 1, 0, -1), (1, "measure", 1, -1, -1), (1, "measure", 4, -1, -1), (1, "measure_synonym", 1, 0, -1), (1, "measure_synonym", 1, 2, -1), (1, "measure_synonym", 1, 5, -1), (1, "measure_synonym", 4, 0, -1), (1, "metric", 1, -1, -1),
    ]
    assert keys(run(spark, [(1, {"meta": {"nova": block}, "columns": {"c": {"meta": {"nova": {"measures": [{"name": "no"}]}}}}})])) == want


def test_where_blocks_are_and_what_is_no_json(spark):
    m = {"measures": [{"name": "m"}]}
    payloads = [
        (1, {"config": {"meta": {"nova": m}}}), (2, {"meta": {"nova": None}, "config": {"meta": {"nova": m}}}), (3, None), (4, ""), (5, '{"meta": {"nova": {"measures": [{"name": "m"}]'), (6, "[1]"), (7, {"nova": m}), (8, '{"a": NaN}'),
        (9, {"meta": {"nova": {"metric": None, "metrics": [{"name": "k"}]}}}), (9, {"meta": {"nova": {"metric": None, "metrics": [{"name": "k"}]}}}), (10, "[" * 50_000), (11, {"meta": {"nova": {"measures": {"name": "no list"}}}}),
        (12, '{"meta": {"nova": {"measures": [{"name": "\\ud800 half"}], "metric": {"name": "' + "x" * 300_000 + '"}}}}'),
    ]
    assert keys(run(spark, payloads)) == [(1, "measure", 0, -1, -1), (2, "measure", 0, -1, -1), (9, "metric", 0, -1, -1), (12, "measure", 0, -1, -1), (12, "metric", 0, -1, -1)]


def test_tables_keep_links(spark):
    t = subtype_tables(run(spark, [(1, {"meta": {"nova": {"metric": {"name": "k", "expression": "a/b", "grain": {"time_field": "t"}, "recommended_filters": [{"field": "f", "operator": "in", "values": ["v", 2]}]}}}})]))
    assert [(r.name, r.expression, r.time_field) for r in t["metric"].collect()] == [("k", "a/b", "t")]
    assert [(r.name, r.operator, r.parent_kind, r.parent_pos_a) for r in t["filter"].collect()] == [("f", "in", "metric", 0)]
    assert sorted((r.value, r.value_type, r.parent_kind, r.parent_pos_b) for r in t["filter_value"].collect()) == [("2", "number", "filter", 0), ("v", "text", "filter", 0)]


def states(*blocks):
    a = ShapeAutomaton()
    return [a.variants[a.record(b, SEMANTIC_BLOCK)[0]] for b in blocks]


def test_equal_shapes_are_one_state():
    one, two, three, four = states(
        {"measures": [{"name": "m", "synonyms": ["p"]}]}, {"measures": [{"name": "n", "synonyms": ["q", "r"]}, {"name": "o", "free": 1}]}, {"measures": [{"name": 1}]}, {"free": {"deep": [1]}, "metric": {"name": "k"}}
    )
    assert one == two == "{measures:[measure]}" and three == "{measures:[other]}" and four == "{metrics:[metric]}"


def test_states_stay_few_where_field_names_are_free():
    a = ShapeAutomaton()
    for i in range(3000):
        a.record({"measures": [{"name": "m", f"x{i}": i, "synonyms": ["s", i, None][: i % 4]}] * (i % 5), f"y{i}": {}}, SEMANTIC_BLOCK)
    assert len(a.accept) < 60


def test_the_automaton_routes_the_rows(monkeypatch):
    block = {"measures": [{"name": "m", "synonyms": ["s"]}], "metric": {"name": "k"}}
    assert [r[0] for r in flatten(block, ShapeAutomaton())] == ["measure", "measure_synonym", "metric"]

    class Blind(ShapeAutomaton):
        def move(self, rule, what, below):
            at = super().move(rule, what, below)
            self.accept[at] = None
            return at

    assert list(flatten(block, Blind())) == []


def test_deep_free_fields_lose_no_records(spark):
    deep = "[" * 700 + "]" * 700
    text = '{"meta": {"nova": {"measures": [{"name": "m", "expression": %s, "free": %s, "synonyms": ["s"]}]}}}' % (deep, deep)
    assert keys(run(spark, [(1, text)])) == [(1, "measure", 0, -1, -1), (1, "measure_synonym", 0, 0, -1)]


def test_empty(spark):
    assert run(spark, []).count() == 0
