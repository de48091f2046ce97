"""Nearest vectors: recall against brute force, ties, copies and unusable vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.llm.neighbours import Router, exact_neighbours, neighbour_pairs, neighbours, recall

SCHEMA = "vec_id long, entity_id string, model_name string, dense_embedding array<float>, similarity double"


def frame(spark, rows):
    return spark.createDataFrame([(i, f"e{i}", m, None if v is None else [None if x is None else float(x) for x in v], 0.0) for i, m, v in rows], SCHEMA)


def clusters(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((20, dim))
    which = rng.integers(0, 20, n) * (rng.random(n) < 0.67)  # a third in one topic
    return centre[which] + 0.35 * rng.standard_normal((n, dim))


@pytest.mark.parametrize(("cell_rows", "flat_cells"), [(500, 64), (100, 4)])  # the second routes on two levels and splits cells
def test_recall_over_several_cells(spark, cell_rows, flat_cells):
    x = clusters(4000)
    x[:900] = x[0] + 0.01 * np.random.default_rng(9).standard_normal((900, 64))  # one very dense cell
    rows = [(i, "a" if i % 5 else "b", v) for i, v in enumerate(x)]
    got: dict[int, set] = {}
    found = neighbours(frame(spark, rows), cell_rows=cell_rows, flat_cells=flat_cells)
    for r in found.collect():
        got.setdefault(r.vec_id, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    model = np.array([i % 5 > 0 for i in range(len(x))])
    hits = total = 0
    for i in range(0, len(x), 50):
        s = u @ u[i]
        s[(model != model[i])] = -9
        s[i] = -9
        want = set(np.argsort(-s, kind="stable")[:5].tolist())
        hits += len(want & got[i])
        total += 5
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(x)
    assert hits / total >= 0.9
    exact = exact_neighbours(frame(spark, rows), block=30)
    by_id: dict[int, list] = {}
    for r in exact.orderBy(F.desc("similarity")).collect():
        by_id.setdefault(r.vec_id, []).append(r.other)
    s = u @ u[50]
    s[(model != model[50])] = s[50] = -9
    assert set(by_id) == set(range(0, 4000, 50)) and by_id[50] == np.argsort(-s, kind="stable")[:5].tolist()
    measured = {r.model_name: (r.queries, r.recall) for r in recall(found, exact).collect()}
    assert measured["b"][0] == 80 and measured["b"][1] == pytest.approx(hits / total, abs=0.01)


def test_router_parts_hold_every_pair():
    rng = np.random.default_rng(4)
    x = clusters(3000, 5).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = Router.fit(x, 12)
    router.split(x, 1.0, 40)
    assert router.home_parts.max() > 1 and router.query_parts.max() > 1
    row, cell, part, home, query = router.route(x, rng.permutation(3000))
    _, visited, near = router.visits(x)
    assert len(np.unique(np.stack([row, cell, part]), axis=1)[0]) == len(row) and (home | query).all()
    where: dict[tuple, tuple[set, set]] = {}
    for r, c, p, h, q in zip(row, cell, part, home, query, strict=True):
        held = where.setdefault((c, p), (set(), set()))
        if h:
            held[0].add(r)
        if q:
            held[1].add(r)
    for c in range(12):  # each visiting query meets each vector of the cell in exactly one part
        pairs = [(a, b) for (cc, _), (hs, qs) in where.items() if cc == c for a in hs for b in qs]
        asks = {b for (cc, _), (_, qs) in where.items() if cc == c for b in qs}
        assert len(pairs) == len(set(pairs)) == (near == c).sum() * len(asks)


def test_small_models_are_exact_and_dirt_is_ignored(spark):
    x = clusters(30, 1)
    rows = [(i, None, v) for i, v in enumerate(x)]
    bad = [(100, None, None), (101, None, [1.0] * 32), (102, None, [0.0] * 64), (103, None, [float("nan")] * 64), (104, None, [None] + [1.0] * 63), (105, None, []), (106, None, [float("inf")] + [1.0] * 63), (None, None, x[0])]
    other = [(200, "m", x[0]), (201, "m", x[1])]
    got = neighbours(frame(spark, rows + rows[:3] + bad + other))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(30):
        s = u @ u[i]
        s[i] = -9
        want |= {(i, int(j)) for j in np.argsort(-s, kind="stable")[:5]}
    assert {(r.vec_id, r.other) for r in got.collect()} == want | {(200, 201), (201, 200)}
    assert {(r.vec_a, r.vec_b) for r in neighbour_pairs(got).collect()} == {(min(p), max(p)) for p in want} | {(200, 201)}


def test_many_copies_take_the_smallest_ids(spark):
    x = clusters(10, 2)
    rows = [(i, "m", x[0]) for i in range(40)] + [(100 + i, "m", v) for i, v in enumerate(x[1:])]
    got: dict[int, set] = {}
    for r in neighbours(frame(spark, rows)).collect():
        got.setdefault(r.vec_id, set()).add(r.other)
    for i in range(40):
        assert got[i] == set([j for j in range(6) if j != i][:5]), i
    assert all(len(v) == 5 for v in got.values()) and len(got) == 49


def test_many_unusable_copies_have_no_neighbours(spark):
    x = clusters(10, 3)
    kinds = [[0.0] * 64, [-0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] + [1.0] * 63]
    bad = [(1000 * (j + 1) + i, "m", v) for j, v in enumerate(kinds) for i in range(9)]
    got = neighbours(frame(spark, [(i, "m", v) for i, v in enumerate(x)] + bad)).collect()
    assert {r.vec_id for r in got} == set(range(10)) and {r.other for r in got} <= set(range(10)) and len(got) == 50


def test_empty(spark):
    assert exact_neighbours(frame(spark, [])).count() == 0
    assert neighbours(frame(spark, [])).count() == 0
