"""Orphan references against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from metaloom.operators.orphans import orphan_references, orphan_report

REF = "row_id long, package_name string, unique_id string, parent_ids array<string>, recorded_at timestamp_ntz, loaded_at timestamp_ntz, ref_table string"
ENT = "unique_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, id string"
T = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T + timedelta(days=n)


def frames(spark, refs, ents):
    r = spark.createDataFrame([(i, "p", u, ps, day(t), day(t), "clash") for i, u, ps, t in refs], REF)
    e = spark.createDataFrame([(u, day(a), day(b), "clash") for u, a, b in ents], ENT)
    return {"parent_map": (r, "parent_ids")}, e


def found(df):
    return sorted((r.row_id, r.ref_id, r.reason) for r in df.collect())


def test_reasons_edges_and_spelling(spark):
    refs = [
        (1, " A ", ["b", "B ", None, "  ", " c"], 10),  # b counts once; c is late
        (2, "a", None, 5),  # created at 5: exists from that instant
        (3, "a", [], 20),  # deleted at 20: no longer there at that instant
        (4, None, ["x"], 3),
        (5, "a", ["b"], None),  # names no instant
        (1, " A ", ["b", "B ", None, "  ", " c"], 10),  # a copy
    ]
    ents = [("a", 5, 20), ("A", 30, None), ("b", 0, 8), ("b", 9, 9), ("c", 11, None), (None, 0, None), ("d", None, None)]
    assert found(orphan_references(*frames(spark, refs, ents))) == [(1, "b", "deleted"), (1, "c", "late"), (3, "a", "deleted"), (4, "x", "missing")]


def test_empty_tables(spark):
    t, e = frames(spark, [], [])
    assert orphan_references(t, e).count() == 0
    t, e = frames(spark, [(1, "a", ["b"], 1)], [])
    assert {r[2] for r in found(orphan_references(t, e))} == {"missing"}


def test_random_and_hot_keys_against_brute_force(spark):
    rnd = random.Random(5)
    ents = [(f"e{rnd.randrange(12)}", rnd.randrange(50), rnd.choice([None, rnd.randrange(60)])) for _ in range(25)]
    refs = [(i, f"e{rnd.randrange(14)}", ["hot"] + [f"E{rnd.randrange(14)} " for _ in range(rnd.randrange(3))], rnd.randrange(60)) for i in range(400)]
    ents += [("hot", 5, 20), ("hot", 40, None)]
    want = set()
    for i, u, ps, t in refs:
        for x in {u, *[p.strip().lower() for p in ps]}:
            own = [(a, b) for e, a, b in ents if e == x and (b is None or b > a)]
            if not any(a <= t and (b is None or b > t) for a, b in own):
                want.add((i, x, "deleted" if any(a <= t for a, b in own) else "late" if own else "missing"))
    for least in (20_000, 10):  # the second splits the hot key
        assert found(orphan_references(*frames(spark, refs, ents), part_rows=least)) == sorted(want)


def test_report(spark):
    rep = orphan_report(orphan_references(*frames(spark, [(1, "a", ["b"], 1), (2, "a", [], 40)], [])))
    assert sorted((r.period, r.orphan_references) for r in rep.collect()) == [("2024-01", 2), ("2024-02", 1)]
