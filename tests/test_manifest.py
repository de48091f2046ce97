"""Reading manifests and catalogs, and the order rules that change results."""

from __future__ import annotations

import json

from metaloom.operators import inventory
from metaloom.queries import metadata
from metaloom.sources import manifest


def model(uid, deps=(), **more):
    return {"resource_type": "model", "name": uid.split(".")[-1], "package_name": "p", "depends_on": {"nodes": list(deps)}, **more}


DOC = {
    "nodes": {
        "model.p.a": model("model.p.a", tags="lone", original_file_path="./models/a.sql", config={"materialized": "table", "meta": {"owner": "low", "nova": {"role": "metric", "grain": {"primary_key": ["id"]}}}}, meta={"owner": None, "nova": {"grain": {"time_field": "t"}}},
                           columns={"Id": {"data_type": "int", "meta": {"primary_key": "TRUE", "nova": {"role": "identifier", "synonyms": ["key"]}}}, "c": {"data_type": "text"}}),
        "model.p.b": model("model.p.b", ["model.p.a"]),
        "analysis.p.x": {"resource_type": "analysis", "name": "x", "depends_on": {"nodes": ["model.p.a"]}}, "analysis.p.y": {"resource_type": "analysis", "name": "y", "depends_on": {"nodes": ["model.p.a", "model.p.b"]}},
        "test.p.t": {"resource_type": "test", "name": "t", "attached_node": "model.p.a", "column_name": "Id", "test_metadata": {"name": "unique"}, "depends_on": {"nodes": ["model.p.a", "model.p.b"]}},
    },
    "sources": {"source.p.s.t": {"name": "t"}}, "metadata": {},
}


def load(spark, *docs):
    return manifest.entities(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "content string"))


def test_entities_columns_tests(spark):
    e = load(spark, DOC, "no json", "[]")
    rows = {r.unique_id: r for r in e.collect()}
    a = rows["model.p.a"]
    assert len(rows) == 6 and a.owner == "low" and a.tags == ["lone"] and a.path == "models/a.sql" and a.materialization == "table" and rows["source.p.s.t"].resource_type == "source"
    assert json.loads(a.nova) == {"role": "metric", "grain": {"primary_key": ["id"], "time_field": "t"}}
    c = {r.column_name: r for r in manifest.columns(e).collect()}
    assert c["Id"].primary_key is True and c["Id"].role == "identifier" and c["Id"].synonyms == ["key"] and c["c"].primary_key is None
    assert {(r.child, r.parent) for r in manifest.dependency_edges(e.where("resource_type = 'model'")).collect()} == {("model.p.b", "model.p.a")}
    assert {(r.unique_id, r.column_name, r.test_name) for r in manifest.attach_tests(e).collect()} == {("model.p.a", "Id", "unique"), ("model.p.b", None, "unique")}


def test_pruning_keeps_whole_analyses(spark):
    kept = {r.unique_id for r in manifest.prune(load(spark, DOC), ["model.p.a"], []).collect()}
    assert kept == {"model.p.a", "analysis.p.x"}
    assert "analysis.p.x" not in {r.unique_id for r in manifest.prune(load(spark, DOC), [], ["analysis*"]).collect()}


def test_manifest_parent_map_replaces_derived_edges(spark):
    d = spark.createDataFrame([(json.dumps({**DOC, "parent_map": {"model.p.z": ["model.p.a"]}}),)], "content string")
    assert [(r.child, r.parent) for r in manifest.dependency_edges(manifest.entities(d), d).collect()] == [("model.p.z", "model.p.a")]


def test_catalog_and_versions(spark, tmp_path):
    cat = spark.createDataFrame([(json.dumps({"nodes": {"model.p.a": {"columns": {"ID": {"type": "bigint"}, "new": {"dtype": "text", "comment": "c"}}}}}),)], "content string")
    e = load(spark, DOC)
    drift = {(r.column_name, r.drift, r.data_type) for r in manifest.catalog_drift(manifest.columns(e), manifest.catalog_columns(cat)).collect()}
    assert drift == {("id", "type_mismatch", "bigint"), ("new", "catalog_only", "text"), ("c", "missing_in_catalog", "text")}
    docs = spark.createDataFrame([(json.dumps(DOC),)], "content string")
    one = manifest.write_version({"entities": e}, str(tmp_path), docs)
    assert manifest.write_version({"entities": e}, str(tmp_path), docs) == one and manifest.read_current(spark, str(tmp_path), "entities").count() == 6


def test_overlay():
    assert manifest.overlay({"a": 1, "b": {"c": 1, "d": 2}}, {"a": None, "b": {"c": 3, "e": [1]}}) == {"a": 1, "b": {"c": 3, "d": 2, "e": [1]}}


def test_inventory_edge_cases(spark):
    rows = [(" A ", "model", "n", None, "d", "s", ["x", "x", None], None), ("b", "MODEL", "n", "p", "d", "s2", None, None), (None, "model", "z", "p", None, None, [], None)]
    e = inventory.current(spark.createDataFrame(rows, "unique_id string, resource_type string, entity_name string, package_name string, database_name string, schema_name string, tags array<string>, created_at timestamp_ntz"))
    assert {(r.tag, r.entities) for r in inventory.count_by_tag(e).collect()} == {("x", 1)}
    assert {r.package_name for r in inventory.count_by_package(e).collect()} == {"", "p"}
    assert inventory.matching(e, "Model", None, None, "d.s").count() == 1 and inventory.matching(e, None, None, None, "S").count() == 2
    assert inventory.lookup(e, "A").count() == 1 and inventory.lookup(e, "n").count() == 2 and inventory.lookup(e, "N").count() == 0
    assert inventory.page(e, ["unique_id"], 1, 1).first().unique_id == "b"


def test_declared_columns_of_payloads_keep_whole_names(spark, tmp_path):
    payloads = [
        '{"columns": {"closed_at_6b": {"data_type": "date"}, "closed_at_1f": {"data_type": "date"}, "plain": {"meta": {}, "data_type": "int"}, "with space": {"data_type": "numeric(10,2)"}, "untyped": {}, "odd": 3}}',
        '{"columns": {"lost_aa": {"data_type": "int"}}', '{"other": {"nested_aa": {"data_type": "int"}}}', "[1]", None,
    ]
    spark.createDataFrame([(" M.a", p) for p in payloads], "unique_id string, payload_json string").write.parquet(str(tmp_path / "nova_blocks.parquet"))
    got = [tuple(r) for r in metadata._payload_columns(spark, str(tmp_path)).collect()]
    assert len(got) == 5 and set(got) == {("m.a", "closed_at_6b", "date"), ("m.a", "closed_at_1f", "date"), ("m.a", "plain", "int"), ("m.a", "with space", "numeric(10,2)"), ("m.a", "untyped", None)}
