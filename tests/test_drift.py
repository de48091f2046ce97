"""Schema changes and the united table on small files, and against a plain fold over random ones."""

from __future__ import annotations

import json
import random

import pytest

from metaloom.operators.drift import file_schemas, promote, schema_changes, united_fields, united_table, united_values

SCHEMA = "file_id long, project_name string, file_seq int, content string, section string"


def frame(spark, files):
    return spark.createDataFrame([(i, p, s, c if isinstance(c, str) or c is None else json.dumps(c), "clash") for i, (p, s, c) in enumerate(files)], SCHEMA)


def changes(spark, files, block=4096):
    f = frame(spark, files)
    got, _ = schema_changes(f, file_schemas(f), block)
    return sorted((r.project_name, r.file_seq, r.field_path, r.change_kind) for r in got.collect())


def doc(meta, *nodes):
    return {"metadata": meta, "nodes": list(nodes)}


def test_every_kind_of_change(spark):
    files = [
        ("p", 1, doc({"v": "1.6", "n": 4, "flag": True, "gone": "z", "deep": {"a": "k1"}}, {"unique_id": "u", "x": 10}, {"unique_id": "w", "x": 20})),
        ("p", 4, doc({"version": "1.6", "n": None, "flag": True, "deep": {"a": "k1"}, "fresh": 9}, {"unique_id": "u", "y": 10}, {"unique_id": "w", "y": 99})),
        ("p", 4, '{"nodes":[{"y":10,"unique_id":"u"},{"unique_id":"w","y":99}], "metadata": {"fresh": 9, "version":"1.6","n":null,"flag":true,"deep":{"a":"k1"}}}'),
        ("p", 9, doc({"version": "1.6", "n": "4", "flag": [True], "moved": {"b": "k1"}, "fresh": 9}, {"unique_id": "u", "y": 10}, {"unique_id": "w"})),
        ("p", 7, "no json"), ("p", None, doc({"a": 1})), (None, 3, doc({"a": 1})), ("p", 8, None),
    ]
    assert changes(spark, files) == sorted([
        ("p", 4, "metadata.version", "renamed"), ("p", 4, "metadata.gone", "removed"), ("p", 4, "metadata.fresh", "added"), ("p", 4, "nodes.y", "renamed"),
        ("p", 9, "metadata.n", "retyped"), ("p", 9, "metadata.flag", "retyped"), ("p", 9, "metadata.moved.b", "renamed"),
    ])


def test_rename_carries_content_from_before_a_null(spark):
    files = [("p", 1, doc({"old": "h1", "k": 1})), ("p", 2, doc({"old": None, "k": 1})), ("p", 3, doc({"new": "h1", "k": 1})), ("p", 4, doc({"new": "h1", "K": 2}))]
    assert changes(spark, files) == [("p", 3, "metadata.new", "renamed"), ("p", 4, "metadata.K", "added"), ("p", 4, "metadata.k", "removed")]


def united(spark, files):
    f = frame(spark, files)
    schemas = file_schemas(f)
    return f, united_fields(schemas, *schema_changes(f, schemas))


def test_united_table(spark):
    f, fields = united(spark, [("p", 1, doc({"v": 1, "file_seq": "own"}, {"unique_id": "u", "n": 3})), ("p", 2, doc({"version": 1, "file_seq": "own"}, {"unique_id": "u", "n": "four"}))])
    meta = united_table(f, fields, "metadata")
    assert len(set(meta.columns)) == len(meta.columns)
    name = next(c for c in meta.columns if c in ("v", "version"))
    assert sorted(tuple(r) for r in meta.select("file_seq", name, "file_seq_2").collect()) == [(1, 1.0, "own"), (2, 1.0, "own")]
    assert sorted(tuple(r) for r in united_table(f, fields, "nodes").select("file_seq", "n").collect()) == [(1, "3"), (2, "four")]
    assert united_values(f, fields, "nodes").count() == 4
    with pytest.raises(ValueError, match="united_values"):
        united_table(f, fields, "nodes", max_columns=1)


def test_renames_stay_in_their_project_and_never_drop_a_value(spark):
    _, fields = united(spark, [
        ("p", 1, doc({"old": "h"})), ("p", 2, doc({"new": "h"})), ("q", 1, doc({"old": "x", "new": "y"})),
        ("r", 1, doc({"old": "h"})), ("r", 2, doc({"new": "h"})), ("r", 3, doc({"new": "h", "old": "again"})),
    ])
    got = {(r.project_name, r.field_path.split(".")[1]): r.field for r in fields.collect()}
    assert got["p", "old"] == got["p", "new"] and got["q", "old"] != got["q", "new"] and got["r", "old"] != got["r", "new"]


def test_blocks_against_one_fold(spark):
    rnd = random.Random(4)
    files = []
    for p in "ab":
        for s in rnd.sample(range(200), 40):
            meta = {k: rnd.choice([None, s * 10 + i, f"{k}{s}", [s, k]]) for i, k in enumerate("vwxyz") if rnd.random() < 0.7}
            files += [(p, s, doc(meta, *({"unique_id": f"u{i}", **({"c": f"c{i}"} if s % 3 else {"d": f"c{i}"})} for i in range(2))))] * rnd.choice([1, 1, 2])
    want = []
    for p in "ab":
        last, known = None, {}
        for s, c in sorted({s: json.dumps(c) for q, s, c in files if q == p}.items()):
            names = {bool: "boolean", int: "number", str: "text", list: "list", type(None): None}
            now = {f"metadata.{k}": names[type(v)] for k, v in json.loads(c)["metadata"].items()}
            if last is not None:
                want += [(p, s, k, "added") for k in now.keys() - last.keys()] + [(p, s, k, "removed") for k in last.keys() - now.keys()]
                want += [(p, s, k, "retyped") for k in now.keys() & last.keys() if now[k] and known.get(k, now[k]) != now[k]]
            known |= {k: v for k, v in now.items() if v}
            last = now
    one, many = changes(spark, files), changes(spark, files, block=7)
    assert one == many
    assert sorted(x for x in one if x[2].startswith("metadata.")) == sorted(want)
    assert {x[2] for x in one if x[2].startswith("nodes.")} == {"nodes.c", "nodes.d"} and all(x[3] == "renamed" for x in one if x[2].startswith("nodes."))


def test_no_files(spark):
    assert changes(spark, []) == []
    assert changes(spark, [("p", 1, {}), ("p", 2, doc({"a": 1}))]) == [("p", 2, "metadata.a", "added")]


def test_lattice():
    assert promote(None, "number") == "number" and promote("number", None) == "number" and promote("number", "list") == "text" and promote("text", "text") == "text"
