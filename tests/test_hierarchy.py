"""Hierarchies against brute force; both ways of peeling agree."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from metaloom.operators.hierarchy import closure, descend, descendants, hierarchies

UP = "row_id long, project_name string, unique_id string, parent_ids array<string>, recorded_at timestamp_ntz, depth int"
DOWN = "row_id long, project_name string, unique_id string, child_ids array<string>, recorded_at timestamp_ntz, path string"
T = datetime(2024, 1, 1)


def frames(spark, ups, downs):
    u = spark.createDataFrame([(i, p, n, ps, T + timedelta(days=t), 7) for i, (p, n, ps, t) in enumerate(ups)], UP)
    d = spark.createDataFrame([(i, p, n, cs, T, "x") for i, (p, n, cs) in enumerate(downs)], DOWN)
    return u, d


def rows(df):
    return sorted((r.unique_id, r.root_id, r.depth) for r in df.collect())


@pytest.mark.parametrize("limit", [200_000, 0])
def test_trees_loops_and_dirt(spark, limit):
    ups = [
        ("p", "b", ["a"], 1), ("p", "b ", ["z"], 0),  # outdated: z is a node of its own
        ("p", "c", ["B", " b", None, ""], 1), ("p", "l1", ["l2"], 1), ("p", "l2", ["l3"], 1), ("p", "l3", ["l1"], 1), ("p", "t", ["l2"], 1), ("p", "tt", ["t"], 1), ("p", "self", ["self"], 1), ("p", "lone", None, 1), ("p", None, ["named"], 1),
    ]
    downs = [("p", "c", ["D", None, " "]), ("p", "d", []), ("p", "a", ["b", "B"]), ("p", "  ", ["loose"])]
    want = sorted([
        ("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("z", "z", 0), ("l1", "l1", -1), ("l2", "l1", -1), ("l3", "l1", -1), ("t", "l1", -2), ("tt", "l1", -2), ("self", "self", -1),
        ("lone", "lone", 0), ("named", "named", 0), ("loose", "loose", 0),
    ])
    assert rows(hierarchies(*frames(spark, ups, downs), max_group_links=limit)) == want


@pytest.mark.parametrize("limit", [200_000, 0])
def test_random_forest_paths_and_closure(spark, limit):
    rnd = random.Random(3)
    parent = {i: rnd.randrange(i) if i % 9 else None for i in range(1, 80)} | {0: None} | {i: i - 1 for i in range(60, 80)}
    ups = [("p", f"n{i}", [f"n{p}"] if p is not None else [], 1) for i, p in parent.items()]

    def path(i):
        return [*path(parent[i]), f"n{i}"] if parent[i] is not None else [f"n{i}"]

    got = hierarchies(*frames(spark, ups, []), with_path=True, max_group_links=limit)
    assert {r.unique_id: (r.root_id, r.depth, r.path) for r in got.collect()} == {f"n{i}": (path(i)[0], len(path(i)) - 1, path(i)) for i in parent}
    pairs = {(r.ancestor_id, r.unique_id, r.distance) for r in closure(got).collect()}
    assert pairs == {(a, f"n{i}", len(path(i)) - 1 - k) for i in parent for k, a in enumerate(path(i)[:-1])}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_descendants_on_and_below_loops(spark, limit):
    parent = {"b": "d", "c": "b", "d": "c", "self": "self", "s1": "self", "t": "c", "u": "t", "v": "u", "w": "t", "a": None, "a1": "a", "a2": "a1"}
    got = hierarchies(*frames(spark, [("p", n, [p] if p else [], 1) for n, p in parent.items()], []), with_path=True, max_group_links=limit)
    want = set()
    for n in parent:
        at, far = parent[n], 1
        while at is not None and at != n and (at, n) not in {w[:2] for w in want}:
            want.add((at, n, far))
            at, far = parent[at], far + 1
    assert len(want) == 26
    pairs = [(r.ancestor_id, r.unique_id, r.distance) for r in closure(got).collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    rows = got.collect()
    assert {r.unique_id: r.descendants for r in rows} == {n: sum(a == n for a, _, _ in want) for n in parent}
    assert all(r.path == [r.unique_id] for r in rows if r.depth < 0)
    sent = [(r.ancestor_id, r.unique_id, r.distance) for r in descendants(*frames(spark, [("p", n, [p] if p else [], 1) for n, p in parent.items()], []), max_group_links=limit).collect()]
    assert len(sent) == len(want) and set(sent) == want


def test_descendant_lists_in_chunks_against_brute_force():
    rnd = random.Random(11)
    for turn in range(40):
        n = rnd.randrange(1, 60)
        up = [rnd.choice([None, *range(n)]) if rnd.random() < 0.8 else None for _ in range(n)]
        child = np.array([f"n{i}" for i in range(n)], object)
        parent = np.array([None if p is None else f"n{p}" for p in up], object)
        want = set()
        for i in range(n):
            at, far, seen = up[i], 1, {i}
            while at is not None and at not in seen:
                want.add((f"n{at}", f"n{i}", far))
                seen.add(at)
                at, far = up[at], far + 1
        got = [r for df in descend(child, parent, 7 if turn % 2 else 10**6) for r in df.itertuples(index=False, name=None)]
        assert len(got) == len(want) and set(got) == want


def test_only_groups_that_share_a_node_leave_the_peel(spark):
    from metaloom.operators.hierarchy import grouped

    ups = [("p", "b", ["a"], 1), ("q", "c", ["b"], 1), ("r", "y", ["x"], 1)]
    _, large, some = grouped(*frames(spark, ups, []), 200_000)
    assert some and {r.grp for r in large.collect()} == {"p", "q"}
    assert {(r.ancestor_id, r.unique_id, r.distance) for r in descendants(*frames(spark, ups, [])).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("x", "y", 1)}


def test_links_across_projects(spark):
    assert rows(hierarchies(*frames(spark, [("p", "b", ["a"], 1), ("q", "c", ["b"], 1)], []))) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]


def test_empty(spark):
    assert hierarchies(*frames(spark, [], [])).count() == 0
