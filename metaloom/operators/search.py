"""Ranked retrieval: postings, BM25, n-grams, slips, phrases, vectors, rank fusion and re-scoring."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from metaloom.functions.scores import levenshtein_similarity, tokens
from metaloom.operators.inventory import layer as layer_of_name
from metaloom.session import cut_lineage

#: Weights of an entity's fields.
FIELD_BOOSTS = {
    "alias": 18.0, "name": 12.0, "description": 6.0, "column": 4.0, "tag": 3.0, "path": 2.0, "code": 1.5, "synonyms": 7.0, "domains": 4.0, "use_cases": 4.0,
    "measures": 8.0, "metric": 10.0, "sensitivity": 6.0, "pii": 8.0, "compliance": 6.0,
}
#: Each persona's weight of a retriever.
RETRIEVER_WEIGHTS = {
    "analyst": {"bm25": 1.0, "ngram": 1.1, "fuzzy": 1.0, "vector": 1.5, "sparse": 1.2, "indicator": 1.6},
    "engineer": {"bm25": 1.5, "ngram": 1.0, "fuzzy": 0.8, "vector": 0.8, "sparse": 1.0, "indicator": 1.0},
    "governance": {"bm25": 1.2, "ngram": 1.0, "fuzzy": 1.0, "vector": 1.0, "sparse": 1.3, "indicator": 1.0},
    "default": {},
}
#: Each persona's weight of a resource type; 1 for others.
TYPE_WEIGHTS = {
    "analyst": {"semantic_model": 1.25, "saved_query": 1.25, "model": 1.25, "metric": 1.1, "exposure": 1.1, "analysis": 1.15, "source": 1.05, "test": 0.65, "macro": 0.45},
    "engineer": {"model": 1.3, "source": 1.2, "test": 1.15, "macro": 1.1, "seed": 1.05, "snapshot": 1.05, "analysis": 0.85, "metric": 0.9, "semantic_model": 0.9, "saved_query": 0.9},
    "governance": {"test": 1.35, "model": 1.2, "source": 1.2, "exposure": 1.15, "metric": 1.05, "semantic_model": 1.05, "saved_query": 1.05, "macro": 0.55},
    "default": {},
}
K1, B = 1.2, 0.75
#: Queries that a task ranks at once, documents laid beside them, pairs of both (8 bytes each), documents among which those alike are looked for, and documents of a task.
BULK_QUERIES, BULK_DOCS, BULK_CELLS, BULK_HELD, BULK_PART = 20_000, 256, 2_000_000, 50_000, 200_000
RRF_K, STAGING, NO_BLOCK, CANONICAL, NGRAM_BOOST = 60.0, 0.6, 0.93, 1.08, 0.35


def postings(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(field, term, id, tf, length): how often each word is in each field of each document, and the field's length in words."""
    rows = None
    for name, text in fields.items():
        words = tokens(F.coalesce(text, F.lit("")))
        part = docs.select(F.lit(name).alias("field"), F.col(key).alias("id"), words.alias("words"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("length", F.size("words")).where("length > 0")
    return rows.select("field", "id", "length", F.explode("words").alias("term")).groupBy("field", "term", "id", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, fields: dict[str, Column], queries: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """(qid, id, score): textbook BM25 of each query's distinct words (qid, term), summed over fields with their boosts.

    Only the postings of the queries' words are aggregated; document numbers and mean
    lengths come from one pass without words. A word in every document keeps a positive
    weight: idf = ln(1 + (n - df + 0.5) / (df + 0.5)).
    """
    terms = queries.select("qid", "term").distinct()
    wanted = terms.select("term").distinct()
    rows = None
    for name, text in fields.items():
        part = docs.select(F.lit(name).alias("field"), F.col(key).alias("id"), tokens(F.coalesce(text, F.lit(""))).alias("words"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("length", F.size("words")).where("length > 0")
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = rows.select("field", "id", "length", F.explode("words").alias("term")).join(wanted, "term").groupBy("field", "term", "id", "length").agg(F.count("*").alias("tf"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    boost = F.lit(1.0)
    for name, value in (boosts or {}).items():
        boost = F.when(F.col("field") == name, value).otherwise(boost)
    weighted = df.join(stats, "field").select("field", "term", (boost * idf).alias("w"), "mean")
    scored = hits.join(weighted, ["field", "term"]).join(terms, "term")
    return scored.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * norm), 6).alias("score"))


class TopK:
    """The k best (score, number) of each of n queries so far; of equal scores the smaller number, which -1 is for none."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.at = k, np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)

    def add(self, rows: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        """Candidates as parallel arrays; a row may come several times."""
        if not len(rows):
            return
        own, row = np.unique(rows, return_inverse=True)
        row = np.concatenate([row, np.repeat(np.arange(len(own)), self.k)])
        s, who = np.concatenate([scores, self.score[own].ravel()]), np.concatenate([at, self.at[own].ravel()])
        order = np.lexsort((who, -s, row))
        first = np.searchsorted(row[order], np.arange(len(own)))
        take = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.at[own] = s[take], who[take]

    def rows(self, qids: pa.Array, ids: list[pa.Array], kind: pa.DataType, most: int = 100_000) -> Iterator[pa.RecordBatch]:
        """What is held, as qid, id and score; ``ids`` has the ids by number, in runs."""
        every = pa.chunked_array(ids, kind)
        q, j = np.nonzero(np.isfinite(self.score))
        for lo in range(0, len(q), most):
            x, y = q[lo : lo + most], j[lo : lo + most]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(x)), every.take(pa.array(self.at[x, y])).combine_chunks(), pa.array(self.score[x, y])], ["qid", "id", "score"])


def laid(docs: DataFrame, queries: DataFrame, many: int, block: int, size: int, part: int = BULK_PART) -> DataFrame:
    """Every query beside every document: parts of about ``part`` documents by groups of at most about ``block`` queries, one task each.

    ``docs`` has id, ``queries`` qid, and both other columns; ``many`` and ``size`` are how many there are. A task gets its queries
    first, with id null, then its documents in the order of their ids. With few documents there
    are as many groups as cores, since a task returns k documents of each of its queries and these are shuffled.
    """
    parts = max(1, -(-many // part))
    groups = max(1, -(-size // block), -(-docs.sparkSession.sparkContext.defaultParallelism // parts))

    def every(n: int, times: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit((n - 1) * times), F.lit(times)))

    d = docs.where("id is not null").withColumn("task", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int") * groups).withColumn("g", every(groups, 1)).withColumn("task", F.col("task") + F.col("g")).drop("g")
    q = queries.withColumn("task", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")).withColumn("p", every(parts, groups)).withColumn("task", F.col("task") + F.col("p")).drop("p")
    return d.unionByName(q, allowMissingColumns=True).repartitionById(parts * groups, "task").drop("task").sortWithinPartitions("id")


def bulk_top(docs: DataFrame, key: str, fields: dict[str, Column], queries: DataFrame, k: int, boosts: dict[str, float] | None = None, block: int = BULK_QUERIES) -> DataFrame:
    """(qid, id, score, rank): the k best of each query by :func:`bm25`, for many queries at once and exactly, no word left out.

    ``queries`` has qid and words. Word counts and lengths are aggregated once; then parts of the
    documents meet groups of the queries, as :func:`laid`. A task lays a
    batch of documents beside all its queries, adds each word's weights to the
    queries that have it, and keeps k of each query. So no (query, document) pair is ever
    shuffled, however common a word is: what leaves a task is k rows a query.

    Words that no document has add nothing, so queries with the same other words are ranked
    once. Documents in which the queries' words weigh the same score alike, so a task scores them
    once, for its next ``BULK_HELD`` documents. It sees them in the order of their ids: of equal scores the first seen counts.
    """
    spark = docs.sparkSession
    names = list(fields)
    texts = docs.select(F.col(key).alias("id"), *[F.coalesce(text, F.lit("")).alias(f"w{i}") for i, text in enumerate(fields.values())]).where("id is not null")
    asked = queries.select("qid", F.explode("words").alias("term")).distinct()
    each = texts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), tokens(F.col(f"w{i}")).alias("words")) for i, n in enumerate(names)])).alias("x")).select("x.*").where(F.size("words") > 0)
    # One pass over the documents; the null term counts them and their words. A semi-join would be pushed below the counting, where every word is shuffled.
    terms = each.select("field", F.size("words").alias("length"), F.explode(F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))).alias("term"))
    wanted = asked.select("term").distinct().unionByName(spark.range(1).select(F.lit(None).cast("string").alias("term")))
    counts = cut_lineage(terms.groupBy("field", "term").agg(F.count("*").alias("count"), F.sum("length").alias("words")).join(wanted.withColumnRenamed("term", "t"), F.expr("term <=> t")).drop("t"))
    stats = {r[0]: (r[1], r[2] / r[1]) for r in counts.where("term is null").select("field", "count", "words").collect()}
    known = counts.where("term is not null")
    met = cut_lineage(asked.join(known.select("term").distinct(), "term").groupBy("qid").agg(F.array_sort(F.collect_list("term")).alias("words")))
    numbered = cut_lineage(met.groupBy("words").agg(F.min("qid").alias("qid")))
    # As many rows as the queries have words, in each field.
    every = known.select("field", "term", "count").toPandas()
    vocabulary, at = np.unique(every["term"].to_numpy(dtype=object), return_inverse=True)
    idf = np.zeros((len(names), len(vocabulary)))
    for i, name in enumerate(names):
        own = (every["field"] == name).to_numpy(dtype=bool)
        df = every["count"].to_numpy(dtype=float)[own]
        idf[i, at[own]] = (boosts or {}).get(name, 1.0) * np.log(1 + (stats.get(name, (0, 1))[0] - df + 0.5) / (df + 0.5))
    mean = [stats.get(n, (0, 1.0))[1] for n in names]
    shared = spark.sparkContext.broadcast((pa.array(vocabulary, pa.string()), idf))
    kind, of = queries.schema["qid"].dataType, texts.schema["id"].dataType
    to_q, to_id = to_arrow_type(kind), to_arrow_type(of)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = shared.value
        n = len(vocabulary)
        asks, ids, seen, best, alike, since = [], [], 0, None, {}, 0
        for batch in batches:
            here = np.flatnonzero(batch.column("id").is_valid().to_numpy(zero_copy_only=False))
            first = here[0] if len(here) else batch.num_rows
            if first:
                asks.append(batch.slice(0, first))
            batch = batch.slice(first)
            if not batch.num_rows or not asks:
                continue
            if best is None:
                qids = pa.chunked_array([a.column("qid") for a in asks], to_q).combine_chunks()
                row, term = pairs(pa.chunked_array([a.column("words") for a in asks]).combine_chunks(), vocabulary)
                order = np.argsort(term, kind="stable")
                rows, begin = row[order], np.searchsorted(term[order], np.arange(n + 1))
                best, used = TopK(len(qids), k), np.diff(begin) > 0
            ids.append(batch.column("id"))
            doc, term, weight = [], [], []
            for i in range(len(names)):
                length = batch.column(f"w{i}").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                d, t = pairs(batch.column(f"w{i}"), vocabulary)
                both, tf = np.unique((d * n + t)[used[t]], return_counts=True)
                d, t = np.divmod(both, max(n, 1))
                doc.append(d)
                term.append(t)
                weight.append(idf[i, t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / mean[i])))
            doc, term, weight = np.concatenate(doc), np.concatenate(term), np.concatenate(weight)
            both, at = np.unique(doc * n + term, return_inverse=True)
            weight = np.bincount(at, weight, len(both))
            doc, term = np.divmod(both, max(n, 1))
            term = term.astype(np.int32)
            own, lo = np.unique(doc, return_index=True)
            # None of a batch's documents may have a word.
            for d, x, y in zip(own.tolist(), lo.tolist(), [*lo.tolist(), len(doc)][1:], strict=True):
                same = alike.setdefault((term[x:y].tobytes(), weight[x:y].tobytes()), [])
                if len(same) < k:
                    same.append(seen + d)
            seen, since = seen + batch.num_rows, since + batch.num_rows
            if since >= BULK_HELD:
                score_alike(best, alike, rows, begin)
                alike, since = {}, 0
        if best is not None:
            score_alike(best, alike, rows, begin)
            yield from best.rows(qids, ids, to_id)

    out = laid(texts, numbered, max([0, *(x[0] for x in stats.values())]), block, numbered.count())
    out = out.select("qid", "id", "words", *[F.when(F.col("id").isNotNull(), tokens(F.col(f"w{i}"))).alias(f"w{i}") for i in range(len(names))])
    best = top(out.mapInArrow(rank, f"qid {kind.simpleString()}, id {of.simpleString()}, score double"), k).withColumnRenamed("qid", "first")
    return met.join(numbered.withColumnRenamed("qid", "first"), "words").select("qid", "first").join(best, "first").select("qid", "id", "score", "rank")


def pairs(words: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number in the vocabulary of each word that is in it."""
    at = pc.index_in(words.flatten(), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row[at >= 0], at[at >= 0]


def score_alike(best: TopK, alike: dict[tuple[bytes, bytes], list[int]], rows: np.ndarray, begin: np.ndarray) -> None:
    """Score documents, whose numbers ``alike`` has by words and their weights, for all queries; word w is in the queries ``rows[begin[w] : begin[w + 1]]``."""
    found = list(alike.items())
    step = batch_size(best)
    for lo in range(0, len(found), step):
        part = found[lo : lo + step]
        term = np.concatenate([np.frombuffer(t, np.int32) for (t, _), _ in part])
        weight = np.concatenate([np.frombuffer(w, np.float64) for (_, w), _ in part])
        doc = np.repeat(np.arange(len(part)), [len(t) // 4 for (t, _), _ in part])
        order = np.argsort(term, kind="stable")
        term, weight, doc = term[order], weight[order], doc[order]
        own, at = np.unique(term, return_index=True)
        score = np.zeros((len(best.score), len(part)))
        for w, x, y in zip(own.tolist(), at.tolist(), [*at[1:].tolist(), len(term)], strict=True):
            score[np.ix_(rows[begin[w] : begin[w + 1]], doc[x:y])] += weight[x:y]
        keep_best(best, score, [same for _, same in part])


def batch_size(best: TopK) -> int:
    """Documents to lay beside the queries at once: ``BULK_DOCS``, fewer beside many queries."""
    return max(16, min(BULK_DOCS, BULK_CELLS // max(1, len(best.score))))


def keep_best(best: TopK, score: np.ndarray, numbers: list[list[int]], least: float = 1e-9, digits: int = 6) -> None:
    """Add to ``best`` what may be among the k best; column d of ``score`` is of the documents ``numbers[d]``, in order.

    Scores count as rounded to ``digits``, and from ``least`` on. Of more columns than k, only those no lower than
    the k-th can be among the k best; of columns with many documents, those no lower than the one with the k-th document.
    """
    k, slack = best.k, 10.0**-digits
    last, after = np.maximum(best.score[:, -1], least), best.at[:, -1]
    may = score >= np.maximum(best.score[:, -1] - slack, least)[:, None]
    full = np.flatnonzero(may.sum(axis=1) > 2 * k)
    if len(full):
        may[full] &= score[full] >= np.partition(score[full], -k, axis=1)[:, -k, None] - slack
    q, d = np.nonzero(may)
    s = np.round(score[q, d], digits)
    first = np.fromiter((n[0] for n in numbers), np.int64, len(numbers))
    ok = (s > last[q]) | (s == last[q]) & ((first[d] < after[q]) | (after[q] < 0))
    q, d, s = q[ok], d[ok], s[ok]
    if not len(q):
        return
    many = np.fromiter(map(len, numbers), np.int64, len(numbers))
    begin, every = np.cumsum(many) - many, np.fromiter((n for same in numbers for n in same), np.int64, int(many.sum()))
    order = np.lexsort((-s, q))
    q, d, s = q[order], d[order], s[order]
    own, start, row = np.unique(q, return_index=True, return_inverse=True)
    before = np.cumsum(many[d]) - many[d]
    ahead = before - before[start][row] < k
    # Ahead are, of each query, the first ones; the last of them has the k-th document, or there are fewer.
    ok = s >= s[start + np.bincount(row, ahead, len(own)).astype(np.int64) - 1][row]
    q, d, s = q[ok], d[ok], s[ok]
    # Rows of whole queries, at most about BULK_CELLS / 4 documents at once.
    n = many[d]
    run = np.cumsum(n) // max(1, BULK_CELLS // 4)
    cuts = np.unique(np.searchsorted(q, q[np.searchsorted(run, np.arange(1, run[-1] + 1))]))
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(q)], strict=True):
        m = n[x:y]
        if len(m):
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            best.add(np.repeat(q[x:y], m), every[np.repeat(begin[d[x:y]], m) + inside], np.repeat(s[x:y], m))


def top(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best of each query, with ``rank`` from 1; of equal scores the smaller id."""
    w = W.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of a text in lower case; of one shorter than n, the text itself."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n))
    return F.when(F.length(low) >= n, F.array_distinct(runs)).when(F.length(low) > 0, F.array(low)).otherwise(F.array().cast("array<string>"))


def ngram_search(docs: DataFrame, key: str, text: Column, query: str, n: int = 3) -> DataFrame:
    """(id, score): share of the query's n-grams that the text has."""
    asked = ngrams(F.lit(query), n)
    both = F.size(F.array_intersect(ngrams(text, n), asked))
    return docs.select(F.col(key).alias("id"), F.round(both / F.size(asked), 6).alias("score")).where("score > 0")


def slips_allowed(term: Column) -> Column:
    n = F.length(term)
    return F.when(n < 4, 0).when(n <= 7, 1).otherwise(2)


def swapped(a: Column, b: Column) -> Column:
    """Whether exchanging two neighbouring letters of a gives b."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    big = 1 << 30
    turned = F.transform(places, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.lit(big))))
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.array_contains(turned, b)


def within_slips(a: Column, b: Column) -> Column:
    """Whether b is within the edits that a's length allows; a swap of neighbours counts as one."""
    n = slips_allowed(a)
    far = F.levenshtein(a, b)
    # A swap costs plain edit distance two.
    return (far <= n) | ((n == 1) & (far == 2) & swapped(a, b))


#: Words up to this length meet by deletions, longer ones by stretches; around it by both.
LONG_WORD = 64


def fuzzy_terms(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, term, match, distance): words of the vocabulary (term) within the slips that a query's word allows.

    Candidates share a key, so the join is on equal keys, never all words by all. Any two
    words within d edits have a common word left when each loses at most d letters. Of
    long words, which have too many such, at least one of three stretches (the first 20
    letters, the last 20, and 20 from the 24th, moved by at most one) is untouched by two edits.
    """
    big = F.lit(1 << 30)

    def cut(t: Column) -> Column:
        return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, big)))).otherwise(F.array().cast("array<string>"))

    def keys(t: Column, places: tuple[int, ...]) -> Column:
        # Words of six letters or more may be met by one that allows two slips.
        one = cut(t)
        short = F.when(F.length(t) < 6, F.concat(F.array(t), one)).otherwise(F.concat(F.array(t), one, F.flatten(F.transform(one, cut))))
        long = F.array(F.concat(F.lit("^"), F.substring(t, 1, 20)), F.concat(F.lit("$"), F.substring(t, -20, 20)), *[F.concat(F.lit("-"), F.substring(t, p, 20)) for p in places])
        none = F.array().cast("array<string>")
        return F.array_distinct(F.concat(F.when(F.length(t) <= LONG_WORD + 2, short).otherwise(none), F.when(F.length(t) >= LONG_WORD - 1, long).otherwise(none)))

    v = vocabulary.select(F.col("term").alias("match")).where("match <> ''").withColumn("key", F.explode(keys(F.col("match"), (23, 24, 25))))
    q = queries.select("qid", "term").where("term <> ''").withColumn("key", F.explode(keys(F.col("term"), (24,))))
    pairs = q.join(v, "key").select("qid", "term", "match").distinct()
    return pairs.where(within_slips(F.col("term"), F.col("match"))).withColumn("distance", F.levenshtein("term", "match"))


def phrase_match(docs: DataFrame, key: str, text: Column, phrase: str) -> DataFrame:
    """(id, times): how often the phrase's words follow each other in the text, overlaps included."""
    asked = " ".join(w for w in re.split(r"[\W_]+", phrase.lower()) if w)
    padded = F.concat(F.lit(" "), F.array_join(tokens(text, 1), " "), F.lit(" "))
    times = F.regexp_count(padded, F.lit(f"(?= {re.escape(asked)} )"))
    return docs.where(text.isNotNull()).select(F.col(key).alias("id"), times.cast("long").alias("times")).where("times > 0")


def highlight(text: Column, terms: list[str], most: int = 240) -> Column:
    """A snippet around the first of the words, which are put in brackets."""
    pattern = "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(map(re.escape, terms)) + ")(?![\\p{L}\\p{N}])"
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - most // 2, F.lit(1))
    return F.when(at > 0, F.regexp_replace(F.substring(text, start, most), pattern, "[$1]"))


def parse_query(text: str) -> dict[str, list]:
    """must, should and must_not words, phrases, and (field, word) pairs of a query in the search syntax."""
    out: dict[str, list] = {"must": [], "should": [], "must_not": [], "phrases": [], "fields": []}
    sign = "should"
    items = re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"()]+))|([()])', text)
    for i, (mark, name, phrase, word, _) in enumerate(items):
        if word in ("AND", "OR", "NOT") and not mark and not name:
            if word == "AND" and out["should"] and sign == "should":
                out["must"].append(out["should"].pop())
            sign = {"AND": "must", "OR": "should", "NOT": "must_not"}[word]
            continue
        kind = {"+": "must", "-": "must_not"}.get(mark, sign)
        sign = "should"
        if name:
            out["fields"].append((name.lower(), (phrase or word).lower()))
        elif phrase:
            out["phrases"].append(phrase.lower())
        elif word:
            out[kind] += [w for w in re.split(r"[^\w]+", word.lower()) if w]
    return out


def boolean_search(docs: DataFrame, key: str, text: Column, query: str, fields: dict[str, Column] | None = None) -> DataFrame:
    """(id, score): documents that fit a boolean query, by how many of its optional words they have, plus one."""
    q = parse_query(query)
    words = tokens(text, 1)
    ok = F.lit(True)
    for w in q["must"]:
        ok = ok & F.array_contains("w", w)
    for w in q["must_not"]:
        ok = ok & ~F.array_contains("w", w)
    padded = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    for p in q["phrases"]:
        ok = ok & F.contains(padded, F.concat(F.lit(" "), F.array_join(tokens(F.lit(p), 1), " "), F.lit(" ")))
    base = docs
    for name, value in q["fields"]:
        base = base.where(F.lower((fields or {})[name]) == value)
    some = sum((F.array_contains("w", w).cast("int") for w in q["should"]), F.lit(0))
    if q["should"] and not (q["must"] or q["phrases"] or q["fields"]):
        ok = ok & (some > 0)
    return base.where(text.isNotNull()).select(F.col(key).alias("id"), words.alias("w")).where(ok).select("id", (some + 1).cast("int").alias("score"))


def fuse(rankings: dict[str, DataFrame], persona: str = "default", k: float = RRF_K) -> DataFrame:
    """(qid, id, score) by weighted reciprocal ranks of (qid, id, rank) rankings, rank from 1."""
    weights = RETRIEVER_WEIGHTS[persona]
    every = None
    for name, df in rankings.items():
        part = df.select("qid", "id", (F.lit(weights.get(name, 1.0)) / (F.lit(k) + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def relative_cutoff(scored: DataFrame, least: int, share: float = 0.01) -> DataFrame:
    """Results in order until, after ``least`` of them, one scores below that share of the one before."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    r = scored.withColumn("rank", F.row_number().over(w)).withColumn("before", F.lag("score").over(w))
    cut = F.max(F.when((F.col("rank") > least) & (F.col("score") < share * F.col("before")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return r.withColumn("cut", cut).where("cut = 0").drop("cut", "before")


def by_type(score: Column, resource_type: Column, persona: str) -> Column:
    out = F.lit(1.0)
    for name, value in TYPE_WEIGHTS[persona].items():
        out = F.when(F.lower(F.trim(resource_type)) == name, value).otherwise(out)
    return score * out


def rescore(hits: DataFrame, persona: str) -> DataFrame:
    """Scores after metadata: layer, persona's type weight, missing block, exact name, canonical entity and matches, in this order.

    ``hits`` has score, resource_type, layer, has_block, exact, canonical, measure_match,
    metric_match and synonym_match. Factors apply in a fixed order, as one bonus is added in between.
    """
    s = F.col("score")
    s = s * F.when(F.col("layer") == "staging", STAGING).otherwise(1.0)
    if persona == "engineer":
        s = s * F.when(F.col("exact"), 2.0).otherwise(1.0)
    s = by_type(s, F.col("resource_type"), persona)
    if persona == "analyst":
        s = s * F.when(~F.col("has_block"), NO_BLOCK).otherwise(1.0)
    matched = F.col("measure_match") | F.col("metric_match") | F.col("synonym_match")
    s = s * F.when(F.col("has_block") & F.col("measure_match"), 1.15).otherwise(1.0)
    s = s * F.when(F.col("has_block") & F.col("metric_match"), 1.2).otherwise(1.0)
    s = s * F.when(F.col("has_block") & F.col("synonym_match"), 1.2).otherwise(1.0)
    s = s * F.when(F.col("has_block") & F.col("canonical"), CANONICAL).otherwise(1.0)
    s = F.when(F.col("has_block") & F.col("canonical") & matched, s * 1.35 + 2.5).otherwise(s)
    return hits.withColumn("final_score", F.round(s, 6))


def hybrid(entities: DataFrame, facts: DataFrame, queries: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, persona: str = "default", resource_types: list[str] | None = None, depth: int = 50, k: int = 10) -> DataFrame:
    """(qid, id, score, rank): one ranking of entities for each question, from all retrievers, re-scored by what their blocks say.

    ``queries`` has qid and query, ``entities`` unique_id, resource_type, entity_name and
    description, ``facts`` as by :func:`~metaloom.operators.payloads.payload_facts`. Each retriever ranks its ``depth``
    best: words (BM25 over name, description, indicators and columns), n-grams of names, words
    within slips of the question's, indicators (names and synonyms of measures and
    metrics, by their entity), and, if ``vectors`` (entities' id and v, questions' qid and v) are given, dense vectors. Ranks are fused with the persona's weights, entities of other
    types than ``resource_types`` are left out before ranking, and :func:`rescore` applies its
    factors to the fused hits. Equal questions, in any case, are ranked once. Null and blank questions have no
    hits; a missing fact counts as absent.
    """
    found = entities if not resource_types else entities.where(F.lower("resource_type").isin([t.lower() for t in resource_types]))
    none = F.array().cast("array<string>")
    texts = found.join(facts.drop("role"), "unique_id", "left").select(
        "unique_id", "resource_type", "entity_name", layer_of_name(F.col("entity_name")).alias("layer"), F.coalesce("has_block", F.lit(False)).alias("has_block"), F.coalesce("canonical_indicator", F.lit(False)).alias("canonical"), F.regexp_replace("entity_name", "[_.]", " ").alias("name"), "description",
        F.coalesce("measure_names", none).alias("measure_names"), F.coalesce("metric_names", none).alias("metric_names"),
        F.array_join(F.concat(F.coalesce("measure_names", none), F.coalesce("metric_names", none)), " ").alias("indicators"), F.array_join(F.coalesce(F.transform("columns", lambda c: F.regexp_replace(c["column_name"], "_", " ")), none), " ").alias("columns"),
        F.flatten(F.concat(F.coalesce(F.transform("measure_list", lambda m: m["synonyms"]), F.array().cast("array<array<string>>")), F.coalesce(F.transform("metric_list", lambda m: m["synonyms"]), F.array().cast("array<array<string>>")))).alias("synonyms"),
    )
    # Numbers in the order of ids stand for them, so that hits are small.
    texts = cut_lineage(texts.sort("unique_id").withColumn("number", F.monotonically_increasing_id()))
    asked = queries.where("trim(query) <> ''").select("qid", F.array_sort(F.array_distinct(tokens(F.regexp_replace("query", "_", " ")))).alias("words"), F.lower(F.trim("query")).alias("query")).where("size(words) > 0")
    once = cut_lineage(asked.groupBy("query").agg(F.min("qid").alias("q"), F.first("words").alias("words")))
    words = once.select(F.col("q").alias("qid"), "words")
    fields = {"name": F.col("name"), "description": F.col("description"), "metric": F.col("indicators"), "column": F.col("columns"), "synonyms": F.array_join("synonyms", " ")}
    rankings = {"bm25": bulk_top(texts, "number", fields, words, depth, FIELD_BOOSTS)}
    # Names without separators, so that a run of three is a word of letters and digits.
    plain = F.regexp_replace(F.lower("entity_name"), "[^a-z0-9]", "")
    asked_runs = once.select(F.col("q").alias("qid"), ngrams(F.regexp_replace("query", "[^a-z0-9]", "")).alias("words"))
    rankings["ngram"] = bulk_top(texts, "number", {"ngram": F.array_join(ngrams(plain), " ")}, asked_runs, depth)
    vocabulary = texts.select(F.explode(tokens(F.concat_ws(" ", "name", "indicators"))).alias("term")).distinct()
    slips = fuzzy_terms(vocabulary, words.select("qid", F.explode("words").alias("term"))).where("distance > 0").groupBy("qid").agg(F.collect_set("match").alias("words"))
    rankings["fuzzy"] = bulk_top(texts, "number", {"name": F.col("name"), "metric": F.col("indicators")}, slips, depth, FIELD_BOOSTS)
    rankings["indicator"] = bulk_top(texts, "number", {"metric": F.col("indicators"), "synonyms": F.array_join("synonyms", " ")}, words, depth, FIELD_BOOSTS)
    if vectors is not None:
        rankings["vector"] = bulk_nearest(vectors[0].join(texts.select(F.col("unique_id").alias("id"), "number"), "id").select(F.col("number").alias("id"), "v"), vectors[1].join(words.select("qid"), "qid", "left_semi"), depth, many=texts.count())
    fused = fuse(rankings, persona)
    q = once.select(F.col("q").alias("qid"), "words", "query")

    def labels(names: str) -> Column:
        """The words of each label that has any, told apart once an entity."""
        each = F.transform(names, lambda x: F.array_distinct(tokens(F.regexp_replace(x, "_", " "))))
        return F.array_distinct(F.filter(each, lambda x: F.size(x) > 0))

    # Of an entity only what re-scoring reads; questions are joined first, so that no entity's labels are ever shuffled with its hits.
    about = cut_lineage(texts.select(F.col("number").alias("id"), "resource_type", "layer", "has_block", F.lower("entity_name").alias("lower_name"), "canonical", labels("measure_names").alias("measures"), labels("metric_names").alias("metrics"), labels("synonyms").alias("synonyms")))
    hits = fused.join(q, "qid").join(about, "id")

    def matches(of: str) -> Column:
        """Whether the question has all words of one of the labels."""
        return F.exists(of, lambda x: F.size(F.array_except(x, F.col("words"))) == 0)

    hits = hits.select("qid", "id", "score", "resource_type", "layer", "has_block", (F.col("lower_name") == F.col("query")).alias("exact"), "canonical", matches("measures").alias("measure_match"), matches("metrics").alias("metric_match"), matches("synonyms").alias("synonym_match"))
    best = top(rescore(hits, persona).select("qid", "id", F.col("final_score").alias("score")), k)
    again = asked.join(once.select("query", "q"), "query").select("qid", "q")
    best = best.join(texts.select(F.col("number").alias("id"), "unique_id"), "id").select(F.col("qid").alias("q"), F.col("unique_id").alias("id"), "score", "rank")
    return again.join(best, "q").select("qid", "id", "score", "rank")


def bulk_nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BULK_QUERIES, many: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k vectors (id, v) most similar by cosine to each query's (qid, v), exactly; groups of queries meet parts of the vectors, as :func:`laid`. ``many`` is a bound on how many vectors there are, where known.

    Vectors that are null, of another length than that of the first query (by qid), not finite or all zero are ignored. Queries of equal vectors are ranked once.
    """
    kind, of = queries.schema["qid"].dataType, vectors.schema["id"].dataType
    to_q, to_id = to_arrow_type(kind), to_arrow_type(of)
    numbered = cut_lineage(queries.where("size(v) > 0").groupBy("v").agg(F.min("qid").alias("first")))
    size = numbered.agg(F.count("*"), F.min_by(F.size("v"), "first")).collect()[0]
    dim = size[1] or 0
    fine = numbered.where(F.size("v") == dim).select(F.col("first").alias("qid"), "v")

    def numbers(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of vectors that count, and these, of length one."""
        flat = values.flatten()
        long = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        good = np.flatnonzero(long == dim)
        start = (np.cumsum(long) - long)[good]
        x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)[start[:, None] + np.arange(dim)].reshape(-1, max(dim, 1))
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.linalg.norm(x, axis=1)
        ok = np.isfinite(length) & (length > 0)
        return good[ok], x[ok] / length[ok][:, None]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, ids, seen, best = [], [], 0, None
        for batch in batches:
            here = np.flatnonzero(batch.column("id").is_valid().to_numpy(zero_copy_only=False))
            first = here[0] if len(here) else batch.num_rows
            if first:
                asks.append(batch.slice(0, first))
            batch = batch.slice(first)
            if not batch.num_rows or not asks:
                continue
            if best is None:
                both = [(a.column("qid"), *numbers(a.column("v"))) for a in asks]
                qids, q = pa.chunked_array([x.take(pa.array(rows)) for x, rows, _ in both], to_q).combine_chunks(), np.concatenate([v for _, _, v in both])
                best = TopK(len(qids), k)
            ids.append(batch.column("id"))
            rows, x = numbers(batch.column("v"))
            step = batch_size(best)
            for lo in range(0, len(rows) if len(q) else 0, step):
                keep_best(best, q @ x[lo : lo + step].T, [[seen + r] for r in rows[lo : lo + step].tolist()], -np.inf, 9)
            seen += batch.num_rows
        if best is not None:
            yield from best.rows(qids, ids, to_id)

    held = vectors.select("id", "v")
    out = laid(held, fine, held.count() if many is None else many, block, size[0], BULK_PART // 4).select("qid", "id", "v")
    best = top(out.mapInArrow(rank, f"qid {kind.simpleString()}, id {of.simpleString()}, score double"), k).withColumnRenamed("qid", "first")
    return queries.join(numbered, "v").select("qid", "first").join(best, "first").select("qid", "id", "score", "rank")


def near_ties(ranked: DataFrame, gap: float = 0.08) -> DataFrame:
    """Whether the next result scores within ``gap`` of each."""
    w = W.partitionBy("qid").orderBy("rank")
    after = F.lead("score").over(w)
    return ranked.withColumn("near_tie", F.coalesce((F.col("score") - after) / F.col("score") < gap, F.lit(False)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_top(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the k vectors nearest to one query by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    return vectors.select(F.col(key).alias("id"), F.round(dot(F.col(column), q) / F.nullif(norm(F.col(column)) * length, F.lit(0.0)), 5).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def signature(column: Column, planes: list[list[float]]) -> Column:
    """A bit for the side of each hyperplane on which the vector lies."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(planes):
        side = dot(column, F.array(*[F.lit(float(x)) for x in p])) >= 0
        out = out + F.when(side, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def planes(bits: int, dim: int) -> list[list[float]]:
    """Hyperplanes with entries from -1 to 1, the same always."""
    state, out = 12345, []
    for _ in range(bits):
        row = []
        for _ in range(dim):
            state = (1103515245 * state + 12345) % 2**31
            row.append(state / 2**30 - 1)
        out.append(row)
    return out


def quantise(column: Column) -> Column:
    """Entries times 127, rounded, as small whole numbers."""
    return F.transform(column, lambda x: F.round(x.cast("double") * 127).cast("tinyint"))


def sparse_dot(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(id, score): sum of products over the dimensions (dim, value) that a document and the query share."""
    q = query.select("dim", F.col("value").alias("qv"))
    return weights.join(q, "dim").groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("qv")), 6).alias("score"))


#: Points for what of an indicator matches the query.
MATCH_POINTS = {"name": 5.0, "synonym": 4.0, "field": 3.0, "description": 2.0, "expression": 1.0}


def indicator_search(inventory: DataFrame, query: str) -> DataFrame:
    """(indicator_id, match_type, score): indicators by their best matching part, with four points for full coverage of the query and one for being canonical.

    Parts are the name, a synonym, the field, the description and the expression; a part's
    coverage is the share of the query's words it has.
    """
    asked = F.array_distinct(tokens(F.lit(query)))
    parts = {"name": "indicator_name", "field": "field_name", "description": "description", "expression": "expression"}
    options = []
    for kind in MATCH_POINTS:
        text = F.array_join(F.coalesce("synonyms", F.array().cast("array<string>")), " ") if kind == "synonym" else F.col(parts[kind])
        share = F.size(F.array_intersect(asked, tokens(F.coalesce(text, F.lit(""))))) / F.size(asked)
        options.append(F.when(share > 0, F.struct((F.lit(MATCH_POINTS[kind]) + 4 * share).alias("score"), F.lit(kind).alias("match_type"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    bonus = F.when(F.coalesce("canonical", F.lit(False)), 1.0).otherwise(0.0)
    return inventory.withColumn("best", best).where("best is not null").select("indicator_id", "best.match_type", F.round(F.col("best.score") + bonus, 6).alias("score"))


def parent_scores(hits: DataFrame, k: int = 3) -> DataFrame:
    """(parent_unique_id, indicators, score): a parent's k best indicator scores summed, as a share of the best parent's sum."""
    w = W.partitionBy("parent_unique_id").orderBy(F.desc("score"), "indicator_id")
    s = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("parent_unique_id").agg(F.count("*").alias("indicators"), F.sum("score").alias("total"))
    most = s.agg(F.max("total").alias("most"))
    return s.join(F.broadcast(most)).select("parent_unique_id", "indicators", F.round(F.col("total") / F.col("most"), 6).alias("score"))  # one row is broadcast


#: Points for what of a column matches.
COLUMN_POINTS = {"name": 6.0, "type": 4.5}


def column_search(columns: DataFrame, query: str) -> DataFrame:
    """(unique_id, column_name, match_type, score): declared columns whose name or type has a word of the query, by points plus overlap."""
    asked = F.array_distinct(tokens(F.lit(query)))
    opts = []
    for kind, c in (("name", "column_name"), ("type", "data_type")):
        n = F.size(F.array_intersect(asked, tokens(F.regexp_replace(c, "_", " "))))
        opts.append(F.when(n > 0, F.struct((F.lit(COLUMN_POINTS[kind]) + n).alias("score"), F.lit(kind).alias("match_type"))))
    best = F.array_max(F.array_compact(F.array(*opts)))
    return columns.withColumn("best", best).where("best is not null").select("unique_id", "column_name", "best.match_type", "best.score")


def suggestions(names: DataFrame, query: str, k: int = 7) -> DataFrame:
    """(name, similarity): the k names most like a query that found nothing."""
    low, q = F.lower("name"), F.lower(F.lit(query))
    return names.select("name").distinct().select("name", F.round(levenshtein_similarity(low, q), 6).alias("similarity")).orderBy(F.desc("similarity"), "name").limit(k)
