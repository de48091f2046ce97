"""Reading levels: prose, isotonic regression, and accuracy on held-out documents."""

from __future__ import annotations

import random

import numpy as np

from metaloom.llm.prose import sentences
from metaloom.llm.reading import BITS, Models, clean_labels, isotonic, ngrams, reading_levels, train

EASY = ["We have the {0}.", "Look at the {0}.", "They see {0} and {1}."]
HARD = ["Notwithstanding the {0} by which the {1} circumscribe the {2}, it remains doubtful whether the {0}, in so far as they problematise the {1}, can be said to warrant the {2}."]
SHORT, LONG = ["cats", "bags", "days", "keys", "rows"], ["epistemic uncertainties", "ontological commitments", "counterfactual attributions", "interoperability desiderata"]


def text(level, rnd):
    out = []
    for _ in range(8):
        hard = rnd.random() < (level - 1) / 4
        words = rnd.sample(LONG if hard else SHORT, 3)
        out.append(rnd.choice(HARD if hard else EASY).format(*words))
    return " ".join(out)


def test_prose():
    assert sentences("# Title\n\nWe have `x` cats. Who sees them?\n- A list item is prose\n") == [["we", "have", "cats"], ["who", "sees", "them"], ["a", "list", "item", "is", "prose"]]
    for none in (None, "", " \n", "```sql\nselect a from b where the cat sat\n```", "select distinct a, b from base\nwhere a is not null\n;", "| a | b |\n|---|---|\n| the cat | sat down here |", "12:01:02 WARN 3 of 40 OK stg__x [1.2s]", "owner_key: int\nrate: string", "---\nowner: me\n---\n", "# only a heading here now"):
        assert sentences(none) == []
    assert sentences("<p>We have cats.</p><p>They see us.</p>") == [["we", "have", "cats"], ["they", "see", "us"]]
    assert len(sentences("We have the cats. " * 20_000)) == 20_000


def test_sentences_that_begin_like_statements():
    for line, words in {
        "from the warehouse the goods are carried to the shop…": 10, "where possible the team should answer within a day.": 9, "end users rarely notice it": 5,
        "select the right table before you begin.": 7, "Be brief.": 2, "return to the shop and ask": 6, "Where an order has no owner, e.g. a test, it is left out.": 14,
    }.items():
        assert sum(map(len, sentences(line))) == words, line
    for code in ("select name\nfrom base\ngroup by 1", "select distinct channel, score from base", "import os", "owner: alice\ntags: x", "update t set a = 1", "for x in rows:\n    return x"):
        assert sentences(code) == [], code
    assert sentences("select a from t\n\nend users rarely notice it") == [["end", "users", "rarely", "notice", "it"]]


def test_batches_and_single_documents_have_equal_features():
    rnd = random.Random(5)
    docs = [sentences(text(rnd.randint(1, 5), rnd)) for _ in range(60)]
    g = ngrams(docs)
    cells, counts = np.unique((2 << BITS) + g.buckets, return_counts=True)
    m = Models(cells, counts)
    folds = np.arange(60) % 5
    whole = m.describe(docs, folds)
    assert np.allclose(whole, np.vstack([m.describe([d], folds[i : i + 1]) for i, d in enumerate(docs)]))
    length = np.array([len(s) for s in docs[7]])
    assert np.allclose(np.exp(whole[7, -4:]), [length.mean(), *np.quantile(length, [0.5, 0.9]), sum(len(w) for s in docs[7] for w in s) / length.sum()])


def test_isotonic_is_nearest_monotone():
    x = np.array([3.0, 1, 2, 4, 5])
    knots, values = isotonic(x, np.array([1.0, 1, 3, 2, 5]))
    assert np.all(np.diff(knots) >= 0) and np.all(np.diff(values) >= 0)
    assert np.allclose(np.interp([1, 2, 3, 4, 5], knots, values), [1, 2, 2, 2, 5])


def test_held_out_accuracy_and_cases(spark):
    rnd = random.Random(1)
    truth = {i: rnd.randint(1, 5) for i in range(500)}
    docs = [(i, text(v, rnd), "clash") for i, v in truth.items()] + [(900, None, "x"), (901, "  ", "x"), (902, "| a | b |", "x")]
    labels = [(i, truth[i], r) for i in range(250) for r in ("a", "b")] + [(1, 9, "c"), (2, None, "c"), (None, 3, "c"), (3, truth[3], "a"), (7777, 3, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, difficulty string")
    lab = spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")
    assert {r.doc_id: r.level for r in clean_labels(lab).collect()}[1] == truth[1]
    got = {r.doc_id: r.reading_level for r in reading_levels(d, lab).collect()}
    assert set(got) == set(truth) and set(got.values()) <= {1, 2, 3, 4, 5}
    unseen = [abs(got[i] - truth[i]) for i in range(250, 500)]
    assert np.mean(unseen) < 0.6 and np.mean(np.array(unseen) <= 1) > 0.9
    plain = {r.doc_id: r.reading_level for r in reading_levels(d, lab, lengths=False).collect()}
    assert set(plain) == set(truth) and np.mean([abs(plain[i] - truth[i]) <= 1 for i in range(250, 500)]) > 0.85
    few = reading_levels(d, lab, max_labelled=60).collect()
    assert len(few) == len(got)
    assert {r.reading_level for r in reading_levels(d, lab.limit(0)).collect()} == {None}
    assert reading_levels(d.limit(0), lab).count() == 0


def test_all_labelled_documents_train_the_models(spark):
    n = 21_000
    d = spark.range(n).selectExpr("id as doc_id", "concat('We see ', element_at(array('cats', 'bags', 'keys'), cast(id % 3 as int) + 1), '.') as text")
    m = train(d, spark.range(n).selectExpr("id as doc_id", "cast(id % 3 as int) + 1 as reading_level", "'a' as rater"))
    # Three words and the end of the sentence, in five kinds of n-grams.
    assert m.counts.sum() == n * 4 * 5


def test_fit_over_partitions_is_that_of_all_at_once(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, (403, 4))
    y = np.clip(np.round(x @ [0.3, 0.2, 0, -0.1] + rng.normal(0, 0.7, 403)), 1, 5)

    def weights(x, y):
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        w = np.linalg.solve(z.T @ z + 3.0 * np.eye(4), z.T @ (y - y.mean())) / x.std(axis=0)
        return np.append(w, y.mean() - x.mean(axis=0) @ w)

    part = np.arange(403) % 10
    unseen = np.empty(403)
    for p in range(10):
        w = weights(x[part != p], y[part != p])
        unseen[part == p] = x[part == p] @ w[:-1] + w[-1]
    m = Models(np.array([]), np.array([]))
    m.fit(spark.createDataFrame([(i, float(v), r.tolist()) for i, (v, r) in enumerate(zip(y, x, strict=True))], "at long, level double, x array<double>").repartition(5))
    assert np.allclose(m.weights, weights(x, y)) and all(np.allclose(a, b) for a, b in zip(m.knots, isotonic(unseen, y), strict=True))
