"""Mixing: shares, caps, balance, and the cube method's own properties."""

from __future__ import annotations

import numpy as np
import pytest

from metaloom.llm.mixing import flight, land, mix, settle_large


def test_flight_keeps_totals_and_leaves_few():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        p = rng.random(n)
        a = np.vstack([rng.integers(1, 500, n).astype(float), np.ones(n)])
        out = flight(p, a, rng)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and (out >= 0).all() and (out <= 1).all()
        assert np.allclose(a @ out, a @ p, rtol=1e-6, atol=1e-4)
        assert set(land(out, a).tolist()) <= {0.0, 1.0}


def test_flight_keeps_chances_on_average():
    a = np.vstack([np.array([5.0, 9, 14, 3, 8, 2]), np.ones(6)])
    p = np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.1])
    mean = np.mean([flight(p, a, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.allclose(mean, p, atol=0.04)


@pytest.mark.parametrize("block", [20_000, 60])
def test_shares(spark, block):
    rng = np.random.default_rng(0)
    docs = [(i, "w " * int(rng.integers(1, 60)), "Big ") for i in range(900)] + [(1000 + i, "w " * int(rng.integers(1, 60)), "small-one") for i in range(80)] + [(2000, "text", None), (2001, None, "big"), (2002, "", "big")]
    targets = [("even", "BIG", 0.5, 1), ("even", "small_one", 0.5, 3), ("solo", "big", 0.4, 2), ("solo", "nowhere", 0.6, 5), (None, "big", 1.0, 1), ("even", None, 0.1, 1), ("void", "nowhere", 1.0, 1), ("none", "big", 0.0, 1)]
    drawn, report = mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int"), block_rows=block)
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    assert abs(rep["even", "big"].actual_share - 0.5) < 0.02 and abs(rep["even", "small_one"].actual_share - 0.5) < 0.02
    assert rep["even", "small_one"].most_copies == 3 and rep["even", "big"].most_copies == 1
    assert rep["solo", "big"].actual_share == 1.0 and rep["solo", "big"].most_copies == 2 and rep["solo", "nowhere"].mix_documents == 0 and rep["void", "nowhere"].actual_share == 0.0
    rows = drawn.collect()
    assert len({(r.mix_name, r.source, r.doc_id) for r in rows}) == len(rows) and not {2000, 2001, 2002} & {r.doc_id for r in rows}
    got = sum(r.tokens * r.copies for r in rows if r.mix_name == "even" and r.source == "big")
    assert got == rep["even", "big"].mix_tokens


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    assert mix(docs, targets)[0].count() == 0
    assert mix(spark.createDataFrame([(1, "t", "a")], docs.schema), targets.limit(0))[0].count() == 0


def test_large_documents_lose_no_tokens():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        tokens = np.concatenate([rng.integers(1, 40, 200), rng.integers(300, 900, 3)]).astype(float)
        chance = np.clip(rng.normal(0.9, 0.2, 203), 0.01, 0.99)  # near 1, where a plain shift would be cut off
        out = settle_large(chance, np.vstack([tokens, np.ones(203)]), rng)
        assert abs(out @ tokens - chance @ tokens) < 1e-6 * tokens.sum() and out.min() >= 0 and out.max() <= 1


def test_equal_sizes_and_zero_sizes_fly():
    rng = np.random.default_rng(0)
    for t in (np.full(50, 7.0), np.zeros(50)):
        out = flight(np.full(50, 0.3), np.vstack([t, np.ones(50)]), rng)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1 and abs(out.sum() - 15) < 1e-6
