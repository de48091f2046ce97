"""Reading level of each document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.prose import sentences
from metaloom.session import cut_lineage

LEVELS, FOLDS = 5, 5
#: The mapping to levels is fitted on weights from other documents, in so many parts.
PARTS = 10
#: N-grams are counted in so many buckets (a power of 2), which bounds the models' size: at most
#: folds x levels x 2^BITS counts of 12 bytes, 79 MB, reach the driver and are broadcast.
BITS = 18
#: Words that are described at once; a longer document is described alone.
STEP_WORDS = 60_000
#: Weight of the next shorter n-gram in the interpolation, and count given to unseen words.
BACKOFF, UNSEEN = 2.0, 0.5
#: Strength of the ridge that keeps weights small where labels are few.
RIDGE = 3.0
#: Kinds of counts: words, pairs, triples, and the contexts of pairs and triples.
KINDS = 5
#: Two surprisals for each level, three quantiles; then lengths of sentences and words.
LENGTH_FEATURES = 4
FEATURES = 2 * LEVELS + 3 + LENGTH_FEATURES
START, END = "\x02", "\x03"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_words: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_words) > 500_000:
        _words.clear()
    for w in set(words) - _words.keys():
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), np.uint64(kind + 1) * MIX[2], np.uint64)
        for p in parts:
            h = (h ^ p) * MIX[0]
            h ^= h >> np.uint64(29)
            h *= MIX[1]
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Grams:
    """The words of several documents, laid end to end: n-gram buckets of the five kinds, and where documents begin."""

    buckets: np.ndarray
    starts: np.ndarray
    #: Words in each sentence, the document's first sentence, and letters in each document.
    lengths: np.ndarray
    first: np.ndarray
    letters: np.ndarray


def ngrams(docs: list[list[list[str]]]) -> Grams:
    """Ends of sentences count as words. Every document has at least one sentence."""
    flat: list[str] = []
    sizes, letters = [], []
    for prose in docs:
        began = len(flat)
        n = 0
        for s in prose:
            flat += (START, START, *s, END)
            n += len("".join(s))
        letters.append(n)
        sizes.append(len(flat) - began - 2 * len(prose))
    h = word_hashes(flat)
    at = np.flatnonzero(h != word_hashes([START])[0])
    w, b, a = h[at], h[at - 1], h[at - 2]
    count = np.fromiter(map(len, docs), np.int64, len(docs))
    lengths = np.fromiter((len(s) for prose in docs for s in prose), np.float64, int(count.sum()))
    return Grams(
        np.stack([bucket(0, w), bucket(1, b, w), bucket(2, a, b, w), bucket(3, b), bucket(4, a, b)]),
        np.concatenate([[0], np.cumsum(sizes)[:-1]]), lengths, np.concatenate([[0], np.cumsum(count)[:-1]]), np.array(letters, np.float64),
    )


def steps(docs: list[list[list[str]]]) -> Iterator[slice]:
    """Runs of documents of at most about STEP_WORDS words each."""
    begin, held = 0, 0
    for i, prose in enumerate(docs):
        n = sum(map(len, prose))
        if held and held + n > STEP_WORDS:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(docs):
        yield slice(begin, len(docs))


@dataclass
class Models:
    """Interpolated n-gram models, one a level, and the mapping of surprisal to a level.

    ``cells`` codes fold, level and bucket, ``counts`` has their counts; a document is scored by
    the models that never saw its fold, so labelled and other documents are treated alike.
    Without ``lengths`` surprisal alone, the plain method, makes the difficulty.
    """

    cells: np.ndarray
    counts: np.ndarray
    lengths: bool = True
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    tables: dict = field(default_factory=dict)

    def table(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        if fold not in self.tables:
            group = self.cells >> BITS
            seen = group // LEVELS != fold
            # A bucket's levels lie side by side, as they are read together.
            counts = np.zeros((1 << BITS, LEVELS + 1), np.float32)
            np.add.at(counts, (self.cells[seen] & ((1 << BITS) - 1), group[seen] % LEVELS), self.counts[seen])
            counts[:, LEVELS] = counts[:, :LEVELS].sum(axis=1)
            # Words are counted once among the five kinds.
            self.tables[fold] = counts, counts.sum(axis=0, dtype=np.float64) / KINDS
        return self.tables[fold]

    def describe(self, docs: list[list[list[str]]], folds: np.ndarray) -> np.ndarray:
        """A row of features for each document, in steps of one fold."""
        out = np.empty((len(docs), FEATURES))
        for fold in np.unique(folds):
            mine = np.flatnonzero(folds == fold)
            for run in steps([docs[i] for i in mine]):
                out[mine[run]] = self.features([docs[i] for i in mine[run]], int(fold))
        return out if self.lengths else out[:, : -LENGTH_FEATURES]

    def features(self, docs: list[list[list[str]]], fold: int) -> np.ndarray:
        """Each document's surprisal under each level's model, its distribution under all, and lengths of words and sentences."""
        g = ngrams(docs)
        counts, total = self.table(fold)
        c = np.moveaxis(counts[g.buckets].astype(np.float64), 2, 0)  # level, kind, word
        size = UNSEEN * 20_000
        one = (c[:, 0] + UNSEEN) / (total[:, None] + size)
        two = (c[:, 1] + BACKOFF * one) / (c[:, 3] + BACKOFF)
        three = (c[:, 2] + BACKOFF * two) / (c[:, 4] + BACKOFF)
        words, text = -np.log(np.minimum(one[:LEVELS], 1)), -np.log(np.minimum(three, 1))
        n = np.diff(np.append(g.starts, g.buckets.shape[1]))
        per = np.diff(np.append(g.first, len(g.lengths)))
        spoken = np.add.reduceat(g.lengths, g.first)
        return np.concatenate([
            np.add.reduceat(words, g.starts, axis=1).T / n[:, None], np.add.reduceat(text[:LEVELS], g.starts, axis=1).T / n[:, None],
            quantiles(text[LEVELS], g.starts, n, (0.1, 0.5, 0.9)),
            np.log(np.column_stack([spoken / per, quantiles(g.lengths, g.first, per, (0.5, 0.9)), g.letters / spoken])),
        ], axis=1)

    def fit(self, known: DataFrame) -> None:
        """Weigh the features of ``known`` (at, level, x) into one difficulty, and map it monotonically to the labels.

        The mapping is fitted on what weights from other documents give, as those of the
        fitted documents themselves would follow their labels too closely. Documents stay on the executors: the driver gets sums
        of products for each part, and the pools that adjacent violators form in each
        stretch of difficulties, which is what pooling all of them at once comes to.
        """
        sums = moments(known)
        whole = sum(sums.values())
        self.weights = ridge(whole)
        shared = known.sparkSession.sparkContext.broadcast({p: ridge(whole - own) if len(sums) > 1 else self.weights for p, own in sums.items()})

        def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, w = np.array(batch["x"].tolist()), np.array([shared.value[p] for p in batch["at"] % PARTS])
                yield pd.DataFrame({"raw": (x * w[:, :-1]).sum(axis=1) + w[:, -1], "at": batch["at"], "level": batch["level"]})

        def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pools: list[list] = []
            for batch in batches:
                pooled(pools, ([level, 1, at, at] for at, level in zip(batch["raw"], batch["level"], strict=True)))
            if pools:
                yield pd.DataFrame(pools, columns=["value", "n", "low", "high"])

        ordered = known.mapInPandas(unseen, "raw double, at long, level double").orderBy("raw", "at")
        # Partitions are collected in their order.
        found = ordered.mapInPandas(pool, "value double, n long, low double, high double").toPandas()
        self.knots = knots(pooled([], found.to_numpy().tolist()))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def difficulty(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def moments(known: DataFrame) -> dict[int, np.ndarray]:
    """For each part of ``known`` (at, level, x): sums of the products of all pairs of features, level and 1."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.array(batch["x"].tolist()), batch["level"], np.ones(len(batch))])
            for p in np.unique(batch["at"] % PARTS):
                mine = z[batch["at"] % PARTS == p]
                sums[p] = sums.get(p, 0) + mine.T @ mine
        if sums:
            yield pd.DataFrame({"part": list(sums), "i": [list(range(s.size)) for s in sums.values()], "s": [s.ravel().tolist() for s in sums.values()]})

    each = known.mapInPandas(add, "part int, i array<int>, s array<double>").select("part", F.explode(F.arrays_zip("i", "s")).alias("z"))
    # As many rows as parts times pairs of features.
    rows = each.groupBy("part", "z.i").agg(F.sum("z.s").alias("s")).orderBy("part", "i").toPandas()
    return {int(p): (m := g["s"].to_numpy()).reshape(int(len(m) ** 0.5), -1) for p, g in rows.groupby("part")}


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights of the features, and the constant, that are nearest to the levels and small; from sums of products (:func:`moments`)."""
    n = sums[-1, -1]
    mean, level = sums[-1, :-2] / n, sums[-1, -2] / n
    spread = sums[:-2, :-2] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0) / n) + 1e-9
    w = np.linalg.solve(spread / np.outer(scale, scale) + RIDGE * np.eye(len(mean)), (sums[:-2, -2] - n * mean * level) / scale) / scale
    return np.concatenate([w, [level - mean @ w]])


def pooled(pools: list[list], more: Iterable[list]) -> list[list]:
    """Add (mean, number, least, largest) in order to ``pools``, joining neighbours until means increase."""
    for own in more:
        pools.append(own)
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, n, _, hi = pools.pop()
            p = pools[-1]
            pools[-1] = [(p[0] * p[1] + v * n) / (p[1] + n), p[1] + n, p[2], hi]
    return pools


def knots(pools: list[list]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([q for p in pools for q in (p[2], p[3])]), np.array([q for p in pools for q in (p[0], p[0])])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing function of x nearest to y, by pooling adjacent violators; as knots, one at each end of a level stretch."""
    order = np.argsort(x, kind="stable")
    return knots(pooled([], ([value, 1, at, at] for at, value in zip(x[order], y[order], strict=True))))


def quantiles(x: np.ndarray, starts: np.ndarray, n: np.ndarray, at: tuple[float, ...]) -> np.ndarray:
    """Quantiles of each run of x, between neighbours in proportion."""
    ordered = x[np.lexsort((x, np.repeat(np.arange(len(n)), n)))]
    place = np.multiply.outer(n - 1, np.array(at))
    low = place.astype(np.int64)
    high = np.minimum(low + 1, (n - 1)[:, None])
    part = place - low
    return ordered[starts[:, None] + low] * (1 - part) + ordered[starts[:, None] + high] * part


def fold_of(doc_id) -> int:
    return xxhash.xxh32_intdigest(str(doc_id)) % FOLDS


def clean_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, level): the mean of a document's ratings from 1 to 5; a rater's repeated rating counts once."""
    valid = labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "rater", "reading_level").distinct()
    return valid.groupBy("doc_id").agg(F.avg("reading_level").alias("level"))


def train(documents: DataFrame, labels: DataFrame, max_labelled: int | None = None, lengths: bool = True) -> Models | None:
    """Models from all labelled documents, or from about ``max_labelled``; None if none of these has prose."""
    spark = documents.sparkSession
    rated = clean_labels(labels)
    share = max_labelled / max(1, rated.count()) if max_labelled else 1
    if share < 1:
        rated = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = documents.select("doc_id", "text").join(rated, "doc_id").select("doc_id", "text", "level")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, level, prose) for i, text, level in batch.itertuples(index=False, name=None) if (prose := sentences(text))]
            for run in steps([p for _, _, p in found]):
                g = ngrams([p for _, _, p in found[run]])
                group = np.array([fold_of(i) * LEVELS + int(np.floor(level + 0.5)) - 1 for i, level, _ in found[run]])
                cell = (np.repeat(group, np.diff(np.append(g.starts, g.buckets.shape[1]))) << BITS) + g.buckets
                cell, n = np.unique(cell, return_counts=True)
                yield pd.DataFrame({"cell": cell, "n": n})

    # At most folds x levels x buckets rows, whatever the number of documents.
    counted = chosen.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).select(F.col("cell").cast("int"), "n").toArrow()
    if not len(counted):
        return None
    models = Models(counted["cell"].to_numpy(), counted["n"].to_numpy(), lengths)
    del counted
    shared = spark.sparkContext.broadcast(models)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, level, prose) for i, text, level in batch.itertuples(index=False, name=None) if (prose := sentences(text))]
            x = shared.value.describe([p for _, _, p in found], np.array([fold_of(i) for i, _, _ in found]))
            yield pd.DataFrame({"doc_id": [i for i, _, _ in found], "level": [v for _, v, _ in found], "x": list(x)})

    known = chosen.mapInPandas(describe, "doc_id long, level double, x array<double>").orderBy("doc_id")
    known = cut_lineage(known.select(F.monotonically_increasing_id().alias("row"), "level", "x"))
    # Parts take turns over the documents in order: rows of a partition are numbered on from those before it.
    held = sorted(known.groupBy(F.shiftright("row", 33).alias("p")).count().collect())
    begins = np.cumsum([0, *(n for _, n in held)])
    begin = spark.createDataFrame([(int(p), int(b)) for (p, _), b in zip(held, begins, strict=False)], "p long, begin long")
    known = known.join(F.broadcast(begin), F.shiftright("row", 33) == F.col("p")).select((F.col("begin") + F.col("row").bitwiseAND((1 << 33) - 1)).alias("at"), "level", "x")  # a row for each partition is broadcast
    models.tables = {}
    models.fit(known)
    return models


def reading_levels(documents: DataFrame, labels: DataFrame, max_labelled: int | None = None, lengths: bool = True) -> DataFrame:
    """(doc_id, reading_level, difficulty, words, sentences, surprisal) of each document whose text holds prose.

    reading_level is 1 (simple words in short statements) to 5 (highly abstract), as raters
    would judge; difficulty is the same before rounding. Texts that are null, blank or
    nothing but code, listings or logs have no row. If no label is usable, reading_level and
    difficulty are null. Texts of any length are read whole; equal texts get levels of their
    own, which may differ by fold only. Labels out of range or null are ignored; raters are
    averaged.

    Method: interpolated n-gram models of words, one for each level, are trained on the
    labelled documents, all of them unless ``max_labelled`` is given; a document's surprisal under each, over
    its whole text, its distribution under all, and the lengths of its words and sentences
    are weighed into one difficulty, which isotonic regression maps to the graded levels.
    Without ``lengths`` surprisal alone makes the difficulty.
    """
    models = train(documents, labels, max_labelled, lengths)
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            found = [(i, prose) for i, text in batch.itertuples(index=False, name=None) if (prose := sentences(text))]
            xs = m.describe([p for _, p in found], np.array([fold_of(i) for i, _ in found])) if m else np.zeros((len(found), FEATURES))
            out = [(i, sum(map(len, p)), len(p), float(x[2 * LEVELS + 1]) if m else None) for (i, p), x in zip(found, xs, strict=True)]
            done = pd.DataFrame(out, columns=["doc_id", "words", "sentences", "surprisal"])
            level = m.difficulty(xs) if m and len(xs) else np.full(len(xs), np.nan)
            done["difficulty"] = pd.array(np.where(np.isnan(level), None, np.round(level, 6)), "Float64")
            done["reading_level"] = pd.array([None if np.isnan(v) else int(min(LEVELS, max(1, np.floor(v + 0.5)))) for v in level], "Int64")
            yield done[["doc_id", "reading_level", "difficulty", "words", "sentences", "surprisal"]]

    fields = "doc_id long, reading_level int, difficulty double, words long, sentences long, surprisal double"
    return documents.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInPandas(score, fields)


def reading_profile(levels: DataFrame, documents: DataFrame, by: str) -> DataFrame:
    """(by, reading_level, documents, words, mean_difficulty): how demanding each part of the corpus is."""
    joined = levels.join(documents.select("doc_id", by), "doc_id")
    return joined.groupBy(by, "reading_level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.avg("difficulty").alias("mean_difficulty"))
