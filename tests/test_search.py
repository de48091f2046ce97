"""Retrieval and scalar functions: hand-computed values and properties."""

from __future__ import annotations

from metaloom.operators.payloads import payload_facts
from metaloom.operators import search
import numpy as np
import random
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metaloom.functions import scores
from metaloom.operators import lineage, search
from metaloom.queries import retrieval


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, None), (4, "bird of prey")], "id long, t string")
    q = spark.createDataFrame([(1, "cat"), (1, "dog"), (1, "dog")], "qid int, term string")
    got = {r.id: r.score for r in search.bm25(docs, "id", {"t": F.col("t")}, q).collect()}
    mean = 7 / 3

    def w(tf, df, length):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))

    assert got == {1: pytest.approx(w(2, 1, 3) + w(1, 2, 3), abs=1e-6), 2: pytest.approx(w(1, 2, 1), abs=1e-6)}
    assert search.bm25(docs.limit(0), "id", {"t": F.col("t")}, q).count() == 0


def test_fusion_golden_value_and_order_of_retrievers(spark):
    one = spark.createDataFrame([(1, "x", 1)], "qid int, id string, rank int")
    assert search.fuse({"bm25": one, "fuzzy": one}).first().score == pytest.approx(0.0327869, abs=1e-7)
    two = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "qid int, id string, rank int")
    a = {r.id: r.score for r in search.fuse({"bm25": one, "ngram": two}, "engineer").collect()}
    assert a == {r.id: r.score for r in search.fuse({"ngram": two, "bm25": one}, "engineer").collect()}


def test_fuzzy_counts_a_swap_once(spark):
    v = spark.createDataFrame([(w,) for w in ("weekly", "weelky", "wekly", "key", "keys", "reconciliation", "report")], "term string")
    q = spark.createDataFrame([(1, "weelky"), (2, "key"), (3, "reconcilatin"), (4, "kye")], "qid int, term string")
    assert {(r.qid, r.match) for r in search.fuzzy_terms(v, q).collect()} == {(1, "weekly"), (1, "weelky"), (2, "key"), (3, "reconciliation")}


def test_boolean_queries_and_highlights(spark):
    d = spark.createDataFrame([(1, "red cats and dogs", "a"), (2, "red dogs", "b"), (3, "blue cats", "a"), (4, None, "a")], "id long, t string, s string")

    def ids(q):
        return sorted(r.id for r in search.boolean_search(d, "id", F.col("t"), q, {"s": F.col("s")}).collect())

    assert ids("red") == [1, 2] and ids("red AND cats") == [1] and ids("cats -red") == [3] and ids('"red dogs"') == [2] and ids("s:a") == [1, 3] and ids("+dogs blue") == [1, 2] and ids("red OR blue") == [1, 2, 3] and ids("cats NOT blue") == [1]
    assert d.select(search.highlight(F.col("t"), ["cats"]).alias("h")).first().h == "red [cats] and dogs"
    assert [(r.id, r.times) for r in search.phrase_match(d, "id", F.col("t"), "Red Dogs").collect()] == [(2, 1)]


def test_cutoff_stops_at_the_gap(spark):
    s = spark.createDataFrame([(1, "a", 10.0), (1, "b", 9.0), (1, "c", 0.01), (1, "d", 0.009)], "qid int, id string, score double")
    assert [r.id for r in search.relative_cutoff(s, 2).orderBy("rank").collect()] == ["a", "b"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("", ""), ("kitten", "sitting"), ("Ünïcode x 42", "b")], "a string, b string")
    assert [r[0] for r in df.select(scores.levenshtein_similarity(F.col("a"), F.col("b"))).collect()][:2] == [1.0, pytest.approx(1 - 3 / 7)]
    assert df.select(scores.tokens("a")).collect()[2][0] == ["ünïcode", "42"]
    t = spark.createDataFrame([("x" * n,) for n in (0, 1, 19, 20, 49, 50, 99, 100)], "t string")
    assert [r[0] for r in t.select(scores.description_tier(F.col("t"), 30)).collect()] == [0, 6, 6, 15, 15, 24, 24, 30]
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 9)], "n int")
    assert [r[0] for r in n.select(scores.array_tier(F.col("n"), 12)).collect()] == [0, 5, 8, 12, 12]
    p = spark.createDataFrame([("a red cat", "red"), ("bored", "red")], "t string, p string")
    assert [r[0] for r in p.select(scores.phrase_contains(F.col("t"), F.col("p"))).collect()] == [True, False]


@settings(max_examples=80, deadline=None)
@given(st.text("ab/?*", max_size=8), st.text("ab/", max_size=8))
def test_globs_against_a_walk(pattern, path):
    def fits(p, s):
        if not p:
            return not s
        if p.startswith("**"):
            return any(fits(p[2:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "*":
            return fits(p[1:], s) or (bool(s) and s[0] != "/" and fits(p, s[1:]))
        return bool(s) and (p[0] == s[0] or (p[0] == "?" and s[0] != "/")) and fits(p[1:], s[1:])

    assert bool(re.match(scores.glob_regex(pattern), path)) == fits(pattern, path)
    assert not fits(pattern, path) or path.startswith(scores.glob_prefix(pattern))


def test_lineage_passes_free_types_and_ends_on_loops(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("x", "a"), ("c", "x")], "child string, parent string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert {(r.id, r.depth) for r in lineage.reach(links, roots).collect()} == {("b", 1), ("x", 1), ("c", 2), ("d", 3), ("a", 4)}
    counted = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {(r.id, r.depth) for r in lineage.reach(links, roots, True, counted, 1).collect()} == {("b", 1), ("x", 0), ("c", 1), ("d", 1), ("a", 1)}
    assert {(r.child, r.parent) for r in lineage.on_cycles(links).collect()} == {(r.child, r.parent) for r in links.collect()}
    assert lineage.on_cycles(links.where("child <> 'a'")).count() == 0


def test_reach_in_tasks_equals_rounds_and_shuffles_no_pairs(spark, monkeypatch):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(110)] + [("n1", "n1"), (None, "n2"), ("n3", None)]
    links = spark.createDataFrame(edges, "child string, parent string")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(40)] + [("n5",), (None,), ("unknown",)], "root string")
    for down, depth in ((True, 200), (False, 200), (False, 2)):
        quick = lineage.reach(links, roots, down, None, depth)
        plan = quick._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("MapInArrow") and "Join" not in plan
        got = sorted(map(tuple, quick.collect()))
        with monkeypatch.context() as m:
            m.setattr(lineage, "MAX_EDGES", 0)
            slow = sorted(map(tuple, lineage.reach(links, roots, down, None, depth).collect()))
        assert got == slow and got
    assert lineage.reach(links.limit(0), roots).count() == 0


def test_column_matches(spark):
    pairs = spark.createDataFrame([("id", "ID", "int", "bigint", False), ("id", "user_id", "int", "int", False), ("id", "text", "int", "string", False), ("a", "b", None, None, True), ("user_id", "userid", "int", "int", False), ("x", "y", "int", "int", False)], "source_column string, target_column string, source_type string, target_type string, alias boolean")
    assert {(r.source_column, r.target_column, r.match_type, r.score) for r in lineage.column_matches(pairs).collect()} == {
        ("id", "ID", "exact_match", 1.0), ("id", "user_id", "suffix_match", 0.24), ("a", "b", "sql_alias", 0.81), ("user_id", "userid", "levenshtein_match", round(0.6 * 6 / 7, 6)),
    }


def test_bulk_ranking_keeps_words_that_most_entities_hold(spark, tmp_path):
    columns = "unique_id string, resource_type string, entity_name string, package_name string, database_name string, schema_name string, materialization string, description string, tags array<string>, created_at timestamp_ntz, deleted_at timestamp_ntz"
    entities = [(f"model.p.e{i:02}", "model", f"invoice_e{i:02}" + "_total" * (i == 7), "p", None, None, None, None, None, None, None) for i in range(30)]
    spark.createDataFrame(entities, columns).write.parquet(str(tmp_path / "entities.parquet"))
    spark.createDataFrame([(1, "Invoice"), (2, "invoice total"), (3, "voucher")], "entry_id long, query string").write.parquet(str(tmp_path / "search_eval_qrels.parquet"))
    got = {}
    for r in retrieval.bm25_bulk(spark, str(tmp_path)).collect():
        got.setdefault(r.qid, {})[r.unique_id] = r.score
    assert {q: len(hits) for q, hits in got.items()} == {1: 10, 2: 10}
    assert max(got[2], key=got[2].get) == "model.p.e07" and min(got[2].values()) > 0


def test_bulk_ranking_equals_single_ranking(spark):
    rnd = random.Random(5)
    words = ["order", "refund", "daily", "the", "stock", "zz9"]
    docs = [(f"d{i:03d}", " ".join(rnd.choices(words, [5, 2, 1, 20, 1, 0], k=rnd.randrange(0, 9))) or None, rnd.choice([None, "order the", "refund"]), "clash") for i in range(300)]
    d = spark.createDataFrame(docs, "id2 string, body string, name string, score string")
    fields = {"description": F.col("body"), "name": F.col("name")}
    asked = [(1, ["the"]), (2, ["order", "refund"]), (3, ["zz9"]), (4, words), (5, [])]
    q = spark.createDataFrame(asked, "qid int, words array<string>")
    one = search.top(search.bm25(d, "id2", fields, q.select("qid", F.explode("words").alias("term")), {"name": 2.0}), 7)
    want = sorted((r.qid, r.id, r.score, r["rank"]) for r in one.collect())
    for block in (20_000, 2):
        got = sorted((r.qid, r.id, round(r.score, 6), r["rank"]) for r in search.bulk_top(d, "id2", fields, q, 7, {"name": 2.0}, block).collect())
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert search.bulk_top(d.limit(0), "id2", fields, q, 7).count() == 0 and search.bulk_top(d, "id2", fields, q.limit(0), 7).count() == 0


def test_bulk_ranking_scores_equal_queries_and_documents_once(spark):
    docs = [(f"d{i % 400:03d}{'x' * (i % 7)}", ["order refund", "order", "the refund of", None][i // 100]) for i in range(400)]
    d = spark.createDataFrame(docs, "id2 string, body string").repartition(3)
    # Queries 1 to 6 are but two once words that no document has are left out.
    asked = [(i, [["order"], ["the", "refund"]][i % 2] + [f"unknown{i}"]) for i in range(1, 7)] + [(7, ["unknown7"])]
    q = spark.createDataFrame(asked, "qid int, words array<string>")
    found = search.bulk_top(d, "id2", {"description": F.col("body")}, q, 5, None, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    one = search.top(search.bm25(d, "id2", {"description": F.col("body")}, q.select("qid", F.explode("words").alias("term"))), 5)
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in one.select("qid", "id", "score", "rank").collect())


def test_bulk_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8))
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("copy", x[0].tolist())]
    v = spark.createDataFrame(rows, "id string, v array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(9)], "qid int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (100, 4):
        got = {}
        for r in search.bulk_nearest(v, q, 4, block).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got[0][:2] == ["copy", "v000"]
        for i in range(1, 9):
            near = [f"v{j:03d}" if j else "v000" for j in np.argsort(-np.round(u @ u[i], 9), kind="stable")]
            assert [n for n in got[i] if n not in ("copy", "v000")] == [n for n in near if n != "v000"][: len([n for n in got[i] if n not in ("copy", "v000")])]


@pytest.mark.parametrize(("a", "b", "ok"), [("abcd", "abdc", True), ("abcd", "adcb", False), ("abcd", "bacd", True), ("abcdefg", "abcdegf", True), ("abc", "acb", False), ("w" * 70 + "x", "w" * 70 + "y", True), ("q" * 30 + "abc" + "r" * 40, "q" * 30 + "abd" + "r" * 39, True)])
def test_slips(spark, a, b, ok):
    v, q = spark.createDataFrame([(b,), ("other",)], "term string"), spark.createDataFrame([(1, a)], "qid int, term string")
    assert [r.match for r in search.fuzzy_terms(v, q).collect()] == ([b] if ok else [])


def test_hybrid(spark):
    blocks = [(1, "m.orders", None, '{"meta": {"nova": {"canonical": true, "metrics": [{"name": "refund rate", "canonical": true, "synonyms": ["money back share"]}]}}, "columns": {"customer_id": {}}}'), (2, "m.bad", None, "{")]
    facts = payload_facts(spark.createDataFrame(blocks, "block_id long, unique_id string, captured_at timestamp_ntz, payload_json string"))
    rows = [("m.orders", "model", "mart_orders", "All orders"), ("m.stock", "model", "stg_stock", "Stock levels"), ("s.stock", "source", "raw_stock", None), ("m.bad", "model", None, None)]
    e = spark.createDataFrame(rows, "unique_id string, resource_type string, entity_name string, description string")
    q = spark.createDataFrame([(1, "refund rate"), (2, "stokc"), (3, None), (4, " "), (5, "Refund Rate"), (6, "customer id"), (7, "money back share")], "qid int, query string")
    v = (spark.createDataFrame([("s.stock", [1.0, 0.0]), ("m.orders", [0.0, 1.0])], "id string, v array<double>"), spark.createDataFrame([(6, [1.0, 0.1])], "qid int, v array<double>"))
    for persona in ("default", "analyst", "engineer", "governance"):
        got = {}
        for r in search.hybrid(e, facts, q, v, persona).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
        assert set(got) == {1, 2, 5, 6, 7} and got[1] == got[5] and got[1][0][0] == "m.orders" and got[1][0][1] > 2.5 and got[7][0][0] == "m.orders"
        assert {i for i, _ in got[2]} == {"m.stock", "s.stock"} and {i for i, _ in got[6]} >= {"m.orders", "s.stock"}
    assert {r.id for r in search.hybrid(e, facts, q, None, "analyst", ["SOURCE"]).collect()} == {"s.stock"}
    assert search.hybrid(e.limit(0), facts, q).count() == 0 and search.hybrid(e, facts.limit(0), q.limit(0)).count() == 0


def test_best_are_held_as_numbers_whatever_the_length_of_ids():
    best = search.TopK(100, 50)
    held = sum(x.nbytes for x in (best.score, best.at))
    numbers = [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(200)]
    score = np.round(np.random.default_rng(4).random((100, 200)), 2)
    for lo in (0, 100):
        search.keep_best(best, score[:, lo : lo + 100], numbers[lo : lo + 100])
    for q in range(100):
        want = sorted((-score[q, d], n) for d in range(200) for n in numbers[d] if score[q, d] > 0)[:50]
        assert [(-s, n) for s, n in zip(best.score[q], best.at[q], strict=True)] == want
    assert sum(x.nbytes for x in (best.score, best.at)) == held == 100 * 50 * 16


def test_hybrid_splits_labels_once_an_entity_and_not_with_each_hit(spark):
    facts = payload_facts(spark.createDataFrame([(1, "m.a", None, '{"meta": {"nova": {"metrics": [{"name": "refund rate"}]}}}')], "block_id long, unique_id string, captured_at timestamp_ntz, payload_json string"))
    e = spark.createDataFrame([("m.a", "model", "orders", "All orders")], "unique_id string, resource_type string, entity_name string, description string")
    found = search.hybrid(e, facts, spark.createDataFrame([(1, "refund rate")], "qid int, query string"))
    matching = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "exists(" in line]
    assert matching and all("split" not in line for line in matching)


def test_few_candidates_are_laid_out_at_once_however_many_documents_are_alike(monkeypatch):
    most, add = [], search.TopK.add
    monkeypatch.setattr(search.TopK, "add", lambda self, rows, at, scores: (most.append(len(rows)), add(self, rows, at, scores))[1])
    monkeypatch.setattr(search, "BULK_CELLS", 40_000, raising=False)
    numbers = [[100 * j + i for j in range(50)] for i in range(100)]
    for score in (np.ones((40, 100)), np.tile(np.arange(1.0, 101.0), (40, 1))):
        best = search.TopK(40, 50)
        search.keep_best(best, score, numbers)
        want = list(range(50)) if score[0, 1] == 1 else numbers[99]
        assert all(row.tolist() == want for row in best.at)
    assert max(most) <= 40_000 // 4 + 50 * 100


def test_every_query_meets_every_document_once(spark):
    docs, queries = spark.range(100).select(F.col("id").cast("string").alias("id")), spark.range(7).select(F.col("id").alias("qid"))
    rows = search.laid(docs, queries, 100, 2, 7, 30).select(F.spark_partition_id().alias("task"), "id", "qid").collect()
    met, seen = [], {}
    for r in rows:
        asks, ids = seen.setdefault(r.task, ([], []))
        assert not (ids and r.id is None)
        (asks if r.id is None else ids).append(r.qid if r.id is None else r.id)
    for asks, ids in seen.values():
        assert ids == sorted(ids)
        met += [(q, d) for q in asks for d in ids]
    assert len(seen) > 4 and len(met) == len(set(met)) == 700


def test_bulk_ranking_prepares_entities_once(spark, tmp_path):
    columns = "unique_id string, entity_name string, description string, created_at timestamp_ntz"
    spark.createDataFrame([("m.a", "invoice", "Total", None), ("m.b", "invoice_total", None, None)], columns).write.parquet(str(tmp_path / "entities.parquet"))
    spark.createDataFrame([(1, "invoice total")], "entry_id long, query string").write.parquet(str(tmp_path / "search_eval_qrels.parquet"))
    found = retrieval.bm25_bulk(spark, str(tmp_path))
    # Which row of an entity counts is decided before the ranking, not again in it.
    assert "created_at" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.unique_id for r in found.collect()} == {"m.a", "m.b"}


def test_batches_of_documents_without_a_word_of_the_queries(spark):
    d = spark.createDataFrame([(f"d{i:02}", "order" if i == 17 else "stock" if i % 2 else None) for i in range(20)], "id2 string, body string")
    q = spark.createDataFrame([(1, ["order"])], "qid int, words array<string>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        assert [(r.qid, r.id) for r in search.bulk_top(d, "id2", {"description": F.col("body")}, q, 5).collect()] == [(1, "d17")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
