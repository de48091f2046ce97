"""Packing: exact buckets, whole results, no needless split."""

from __future__ import annotations

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from metaloom.llm.packing import LEAST_SHARE, best_buckets, broken_rules, fill_report, least_containers, pack, place, plan


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_buckets_are_optimal(hist, k):
    sizes, counts = np.array(sorted(hist)), np.array([hist[s] for s in sorted(hist)])
    ends = np.concatenate([[0], sizes])
    need = least_containers(sizes, counts, 40, ends)
    at = {int(e): i for i, e in enumerate(ends)}

    def cost(bounds):
        return sum(need[at[a], at[b]] for a, b in itertools.pairwise([0, *bounds]))

    got = best_buckets(sizes, counts, 40, k, 0.0)
    n = min(k, len(sizes))
    assert len(got) == n and cost(got.tolist()) == min(cost((*c, int(sizes[-1]))) for c in itertools.combinations(sizes[:-1].tolist(), n - 1))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=20))
def test_estimate_is_a_lower_bound(hist):
    sizes, counts = np.array(sorted(hist)), np.array([hist[s] for s in sorted(hist)])
    need = least_containers(sizes, counts, 60, np.array([0, sizes[-1]]))[0, 1]
    assert need <= plan(sizes, counts, 60, bounds=sizes[-1:]).containers


def test_bounds_decide_the_containers():
    rng = np.random.default_rng(3)
    sizes, counts = np.arange(1, 101), rng.integers(1, 50, 100)
    plans = {b: plan(sizes, counts, 100, bounds=np.array(b)) for b in ((100,), (50, 100), (30, 60, 100), (75, 100))}
    assert len({p.containers for p in plans.values()}) == 4
    for bounds, p in plans.items():
        size, rank = np.repeat(sizes, counts), np.concatenate([np.arange(c) for c in counts])
        box, bucket = place(p, size, rank), np.searchsorted(bounds, size)
        assert len(np.unique(np.stack([box, bucket]), axis=1)[0]) == p.containers  # one bucket a container
    best = plan(sizes, counts, 100, 4)
    assert len(best.bounds) == 4 and best.containers <= plan(sizes, counts, 100, bounds=np.array([25, 50, 75, 100])).containers


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), min_size=1, max_size=20), st.integers(50, 90), st.booleans())
def test_plan_places_every_item_within_capacity(hist, capacity, fill):
    sizes, counts = np.array(list(hist)), np.array(list(hist.values()))
    p = plan(sizes, counts, capacity, 5, fill)
    size = np.repeat(sizes, counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    box = place(p, size, rank)
    load = np.bincount(box, weights=size, minlength=p.containers)
    assert len(load) == p.containers and load.max() <= capacity and load.min() > 0
    if not fill:
        assert (np.searchsorted(p.bounds, size) == np.searchsorted(p.bounds, [size[box == b].max() for b in box])).all()
    if fill:  # no two containers that could be one
        two = np.sort(load)[:2]
        assert len(load) < 2 or two.sum() > capacity


def test_documents(spark):
    texts = ["one two three", "", None, "word " * 700, "alpha beta", "alpha beta"] + [f"text {i} of some words" for i in range(40)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    specs = spark.createDataFrame([("s", 64), ("s", 64), ("l", 1000), (None, 5), ("bad", 0)], "spec_name string, capacity_tokens int")
    packed, buckets = pack(docs, specs)
    rows = packed.collect()
    for name, cap in (("s", 64), ("l", 1000)):
        own = [r for r in rows if r.spec_name == name]
        assert {r.doc_id for r in own} == {i for i, t in enumerate(texts) if t}
        load: dict[int, int] = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
        for doc in {r.doc_id for r in own}:
            pieces = sorted((r.piece, r.token_from, r.tokens) for r in own if r.doc_id == doc)
            assert [p[0] for p in pieces] == list(range(len(pieces))) and all(p[2] == cap for p in pieces[:-1])
            assert [p[1] for p in pieces] == [cap * i for i in range(len(pieces))]
        assert len([r for r in own if r.doc_id == 3]) == (1 if cap == 1000 else -(-sum(r.tokens for r in own if r.doc_id == 3) // 64))
    report = {r.spec_name: r for r in fill_report(packed, specs).collect()}
    assert report["s"].fill > 0.9 and report["s"].unused_tokens == report["s"].containers * 64 - report["s"].tokens
    assert {r.spec_name for r in buckets.collect()} == {"s", "l"}
    assert pack(docs.limit(0), specs)[0].count() == 0 and pack(docs, specs.limit(0))[0].count() == 0


def test_hot_size_is_ranked_in_parts(spark, monkeypatch):
    from metaloom.llm import packing

    monkeypatch.setattr(packing, "hot_keys", lambda df, key: {r[0]: 3 for r in df.select(key).distinct().collect()})
    docs = spark.createDataFrame([(i, "four words of text") for i in range(101)], "doc_id long, text string")
    packed, _ = pack(docs, spark.createDataFrame([("s", 10)], "spec_name string, capacity_tokens int"))
    per = [r["count"] for r in packed.groupBy("container_id").count().collect()]
    assert sum(per) == 101 and sorted(per)[1:] == [2] * 50


def test_broken_rules_are_counted(spark):
    docs = spark.createDataFrame([(i, "four words of text " * (i % 3 + 1)) for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    specs = spark.createDataFrame([("s", 10)], "spec_name string, capacity_tokens int")
    packed = pack(docs, specs)[0]
    good = broken_rules(packed, docs, specs).first()
    assert (good.documents, *good[3:]) == (60, 0, 0, 0, 0, 0)
    bad = broken_rules(packed.where("doc_id <> 5").withColumn("container_id", packed.container_id % 3), docs, specs).first()
    assert bad.documents == 59 and bad.over_capacity == 3 and bad.mixed_buckets > 0 and bad.tokens_lost == 1
    assert broken_rules(pack(docs, specs.limit(0))[0], docs, specs.limit(0)).count() == 0


def _needed(sizes, counts, capacity, low, high):
    """Containers that the items of sizes in (low, high] need at least, every limit tried one by one."""
    mine = (sizes > low) & (sizes <= high)
    s, n, half = sizes[mine], counts[mine], capacity // 2
    need = [n[s > capacity // (k + 1)].sum() / k for k in range(2, 12)]
    for t in range(half + 1):
        large, small = (s > half) & (s <= capacity - t), (s <= half) & (s >= t)
        room = (n[large] * (capacity - s[large])).sum()
        need.append(n[s > half].sum() + max(0, (n[small] * s[small]).sum() - room) / capacity)
    return np.ceil(max(need) - 1e-9)


def test_every_size_may_be_a_bound():
    capacity = 300
    sizes = np.arange(1, capacity + 1)
    counts = np.maximum(1, np.random.default_rng(11).integers(1, 400, capacity) * np.exp(-sizes / 50)).astype(int)
    held = np.concatenate([[0], np.cumsum(sizes * counts)])
    least = LEAST_SHARE * held[-1]
    costs = {b: _needed(sizes, counts, capacity, 0, b) + _needed(sizes, counts, capacity, b, capacity) for b in range(1, capacity) if min(held[b], held[-1] - held[b]) >= least}
    bounds = best_buckets(sizes, counts, capacity, 2)
    assert bounds[1] == capacity and costs[bounds[0]] == min(costs.values())
