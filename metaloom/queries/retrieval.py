"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.scores import tokens
from metaloom.operators import inventory, payloads, search
from metaloom.queries import metadata
from metaloom.session import cut_lineage, table

TERMS = ["snapshots", "weekly", "reports", "owners"]


def _terms(spark: SparkSession, words: list[str] = TERMS) -> DataFrame:
    return spark.createDataFrame([(1, w) for w in words], "qid int, term string")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "unique_id")


def _text_hits(spark, sf_dir, k: int):
    return search.top(search.bm25(_docs(spark, sf_dir), "doc_id", {"description": F.col("text")}, _terms(spark)), k)


def bm25_topk(spark, sf_dir):
    """Text search: the ten best documents for four words."""
    return _text_hits(spark, sf_dir, 10).select(F.col("id").alias("doc_id"), "score", "rank")


def bm25_boosted(spark, sf_dir):
    fields = {"description": F.col("text"), "tag": F.regexp_replace("source", "_", " "), "name": F.regexp_replace("unique_id", "[._]", " ")}
    hits = search.bm25(_docs(spark, sf_dir), "doc_id", fields, _terms(spark, ["runbooks", "weekly", "invoice"]), search.FIELD_BOOSTS)
    return search.top(hits, 10).select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


def bm25_bulk(spark, sf_dir):
    """Every graded question against all entities' names and descriptions: each question's ten best.

    Questions of the same words are ranked once.
    """
    e = cut_lineage(inventory.current(table(spark, sf_dir, "entities")).select("unique_id", "entity_name", "description"))
    asked = table(spark, sf_dir, "search_eval_qrels").where("query is not null").select(
        F.col("entry_id").alias("entry"), F.array_sort(F.array_distinct(tokens(F.regexp_replace("query", "_", " ")))).alias("words")
    ).distinct()
    once = asked.groupBy("words").agg(F.min("entry").alias("qid"))
    fields = {"name": F.regexp_replace("entity_name", "_", " "), "description": F.col("description")}
    hits = search.bulk_top(e, "unique_id", fields, once.select("qid", "words"), 10, search.FIELD_BOOSTS)
    return asked.join(once, "words").join(hits, "qid").select(F.col("entry").alias("qid"), F.col("id").alias("unique_id"), F.round("score", 3).alias("score"))


def hybrid_search(spark, sf_dir):
    """Every graded question by all retrievers at once, for the analyst: each question's ten best."""
    facts = cut_lineage(payloads.payload_facts(table(spark, sf_dir, "nova_blocks")))
    e = inventory.current(table(spark, sf_dir, "entities"))
    asked = table(spark, sf_dir, "search_eval_qrels").where("query is not null").groupBy(F.col("entry_id").alias("qid")).agg(F.min("query").alias("query"))
    return search.hybrid(e, facts, asked, None, "analyst").select("qid", F.col("id").alias("unique_id"), F.round("score", 4).alias("score"), "rank")


def hybrid_typed(spark, sf_dir):
    """The same for the engineer among models and sources only, with the first vector of each entity and, as a question's vector, that of its first relevant entity."""
    facts = cut_lineage(payloads.payload_facts(table(spark, sf_dir, "nova_blocks")))
    e = inventory.current(table(spark, sf_dir, "entities"))
    rows = table(spark, sf_dir, "search_eval_qrels").where("query is not null").groupBy(F.col("entry_id").alias("qid")).agg(F.min("query").alias("query"), F.min(F.lower(F.trim(F.try_element_at("relevant", F.lit(1))["unique_id"]))).alias("id"))
    v = table(spark, sf_dir, "cached_embeddings").where("entity_id is not null and size(dense_embedding) = 64").groupBy(F.lower(F.trim("entity_id")).alias("id")).agg(F.min_by("dense_embedding", "vec_id").alias("v"))
    found = search.hybrid(e, facts, rows.select("qid", "query"), (v, rows.join(v, "id").select("qid", "v")), "engineer", ["model", "source"])
    return found.select("qid", F.col("id").alias("unique_id"), F.round("score", 4).alias("score"), "rank")


def postings_stats(spark, sf_dir):
    p = search.postings(_docs(spark, sf_dir), "doc_id", {"description": F.col("text")})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def ngram_search(spark, sf_dir):
    e = inventory.current(table(spark, sf_dir, "entities"))
    return search.ngram_search(e, "unique_id", F.col("entity_name"), "invoice_summary").where("score >= 0.4").select(F.col("id").alias("unique_id"), "score")


def fuzzy_terms(spark, sf_dir):
    vocabulary = search.postings(_docs(spark, sf_dir), "doc_id", {"description": F.col("text")}).select("term").distinct()
    return search.fuzzy_terms(vocabulary, _terms(spark, ["snapshts", "wekly", "ownres", "reconcilation", "key"])).select("term", "match", "distance")


def phrase_match(spark, sf_dir):
    return search.phrase_match(_docs(spark, sf_dir), "doc_id", F.col("text"), "the weekly sheets").select(F.col("id").alias("doc_id"), "times")


def boolean_search(spark, sf_dir):
    hits = search.boolean_search(_docs(spark, sf_dir), "doc_id", F.col("text"), '+snapshots weekly owners -buyers source:runbooks', {"source": F.col("source")})
    return hits.select(F.col("id").alias("doc_id"), "score")


def highlights(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text is not null")
    return d.select("doc_id", search.highlight(F.col("text"), ["snapshots"], 60).alias("snippet")).where("snippet is not null")


def suggestions(spark, sf_dir):
    return search.suggestions(inventory.current(table(spark, sf_dir, "entities")).select(F.col("entity_name").alias("name")), "dim__calender_day")


def _rankings(spark, sf_dir):
    words = search.top(search.bm25(_docs(spark, sf_dir), "doc_id", {"description": F.col("text")}, _terms(spark)), 30)
    names = search.ngram_search(_docs(spark, sf_dir), "doc_id", F.col("unique_id"), "snapshot_weekly").withColumn("qid", F.lit(1))
    return {"bm25": words, "ngram": search.top(names, 30)}


def rrf_fusion(spark, sf_dir):
    return search.fuse(_rankings(spark, sf_dir)).select(F.col("id").alias("doc_id"), "score")


def rrf_engineer(spark, sf_dir):
    fused = search.relative_cutoff(search.fuse(_rankings(spark, sf_dir), "engineer"), 10)
    return search.near_ties(fused).select(F.col("id").alias("doc_id"), "score", "rank", "near_tie")


def rescored(spark, sf_dir):
    """All entities with one base score, re-scored for the analyst by what the inventory says of them."""
    e = inventory.current(table(spark, sf_dir, "entities")).where("resource_type is not null and entity_name is not null")
    owned = table(spark, sf_dir, "indicator_inventory").groupBy(F.col("parent_unique_id").alias("unique_id")).agg(
        F.max("canonical").alias("canon"), F.max(F.col("indicator_type") == "measure").alias("m"), F.max(F.col("indicator_type") == "metric").alias("k")
    )
    off = F.lit(False)
    h = e.join(owned, "unique_id", "left").select(
        "unique_id", "resource_type", inventory.layer(F.col("entity_name")).alias("layer"), F.lit(0.5).alias("score"), (F.col("canon").isNotNull() | F.array_contains(F.coalesce("tags", F.array()), "mart")).alias("has_block"), off.alias("exact"),
        F.coalesce("canon", off).alias("canonical"), F.coalesce("m", off).alias("measure_match"), F.coalesce("k", off).alias("metric_match"), F.coalesce(F.array_contains("tags", "certified"), off).alias("synonym_match"),
    )
    return search.rescore(h, "analyst").select("unique_id", "final_score")


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]


def dense_topk(spark, sf_dir):
    return search.vector_top(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 10).select(F.col("id").alias("vec_id"), "score")


PLANES = search.planes(8, 64)


def lsh_candidates(spark, sf_dir):
    """Vectors whose signature differs from the query's in at most two bits."""
    sig = search.signature(F.col("embedding"), PLANES)
    q = sum(1 << i for i, p in enumerate(PLANES) if sum(a * b for a, b in zip(p, QUERY_VECTOR, strict=True)) >= 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", sig.alias("signature")).where(F.bit_count(F.col("signature").bitwiseXOR(F.lit(q))) <= 2)


def quantised_dot(spark, sf_dir):
    q = F.array(*[F.lit(int(round(x * 127))) for x in QUERY_VECTOR])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(search.dot(search.quantise(F.col("embedding")), q) / (127 * 127), 4).alias("score"))


def sparse_dot(spark, sf_dir):
    p = search.postings(_docs(spark, sf_dir), "doc_id", {"description": F.col("text")}).select("id", F.col("term").alias("dim"), (1 + F.ln("tf")).alias("value"))
    q = spark.createDataFrame([(w, 0.5 + i) for i, w in enumerate(TERMS)], "dim string, value double")
    return search.sparse_dot(p, q).select(F.col("id").alias("doc_id"), "score")


def indicator_search(spark, sf_dir):
    return search.indicator_search(table(spark, sf_dir, "indicator_inventory"), "gross margin of supplier invoice")


def indicator_parents(spark, sf_dir):
    inv = table(spark, sf_dir, "indicator_inventory")
    return search.parent_scores(search.indicator_search(inv, "gross margin of supplier invoice").join(inv.select("indicator_id", "parent_unique_id"), "indicator_id"))


def indicator_inventory(spark, sf_dir):
    inv = table(spark, sf_dir, "indicator_inventory").where("indicator_type = 'metric'").select("indicator_id", "indicator_name", "canonical", "parent_unique_id")
    return inventory.page(inv, [F.desc("canonical"), "parent_unique_id", "indicator_name", "indicator_id"], 40, 10)


def column_search(spark, sf_dir):
    return search.column_search(metadata._payload_columns(spark, sf_dir), "status date code")


def column_inventory(spark, sf_dir):
    c = metadata._payload_columns(spark, sf_dir)
    return inventory.page(c, ["unique_id", "column_name", "data_type"], 100, 0)


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_boosted, bm25_bulk, hybrid_search, hybrid_typed, postings_stats, ngram_search, fuzzy_terms, phrase_match, boolean_search, highlights, suggestions, rrf_fusion, rrf_engineer, rescored,
    dense_topk, lsh_candidates, quantised_dot, sparse_dot, indicator_search, indicator_parents, indicator_inventory, column_search, column_inventory,
)}


def _toks(text: str, least: int = 2) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= {least})"


def _bm25(rows: str, terms: str, boosts: str) -> str:
    """``rows``: field, id, words; ``terms``: qid, term."""
    return f"""r AS (SELECT *, len(words) AS length FROM ({rows}) WHERE len(words) > 0), st AS (SELECT field, count(*) AS n, avg(length) AS mean FROM r GROUP BY 1),
      q AS ({terms}), x AS (SELECT field, id, length, unnest(words) AS term FROM r),
      h AS (SELECT field, term, id, length, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM h GROUP BY ALL),
      s AS (SELECT qid, id, round(sum({boosts} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM h JOIN df USING (field, term) JOIN st USING (field) JOIN (SELECT DISTINCT qid, term FROM q) USING (term) GROUP BY qid, id),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)"""


def _values(words: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"(1, '{w}')" for w in words) + ") AS v(qid, term)"


_TEXT = f"SELECT 'description' AS field, doc_id AS id, {_toks('text')} AS words FROM documents WHERE text IS NOT NULL"
_NGRAMS = "list_distinct([substring(lower({c}), CAST(i AS INTEGER), 3) FOR i IN range(1, length({c}) - 1)])"
_E = metadata.E
_VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_EMB = "[CAST(x AS DOUBLE) FOR x IN embedding]"
_RRF = f"""WITH {_bm25(_TEXT, _values(TERMS), "1.0")},
      ng AS (SELECT doc_id AS id, round(len(list_intersect({_NGRAMS.format(c="unique_id")}, {_NGRAMS.format(c="'snapshot_weekly'")}))::DOUBLE / len({_NGRAMS.format(c="'snapshot_weekly'")}), 6) AS score FROM documents WHERE unique_id IS NOT NULL),
      ngr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ng WHERE score > 0),
      u AS (SELECT id, CAST({{w}} AS DOUBLE) / (60 + rank) AS part FROM ranked WHERE rank <= 30 UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM ngr WHERE rank <= 30),
      f AS (SELECT id AS doc_id, round(sum(part), 9) AS score FROM u GROUP BY id)"""

SQL = {
    "bm25_topk": f"WITH {_bm25(_TEXT, _values(TERMS), '1.0')} SELECT id AS doc_id, score, rank FROM ranked WHERE rank <= 10",
    "bm25_boosted": "WITH " + _bm25(
        f"{_TEXT} UNION ALL SELECT 'tag', doc_id, {_toks(chr(39).join(['replace(source, ', '_', ', ', ' ', ')']))} FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'name', doc_id, {_toks('unique_id')} FROM (SELECT doc_id, regexp_replace(unique_id, '[._]', ' ', 'g') AS unique_id FROM documents WHERE unique_id IS NOT NULL)",
        _values(["runbooks", "weekly", "invoice"]), "CASE field WHEN 'description' THEN 6.0 WHEN 'tag' THEN 3.0 WHEN 'name' THEN 12.0 END",
    ) + " SELECT id AS doc_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= 10",
    "bm25_bulk": _E.rstrip() + ", " + _bm25(
        f"SELECT 'name' AS field, unique_id AS id, {_toks('n')} AS words FROM (SELECT unique_id, replace(entity_name, '_', ' ') AS n FROM e WHERE entity_name IS NOT NULL) UNION ALL SELECT 'description', unique_id, {_toks('description')} FROM e WHERE description IS NOT NULL",
        f"SELECT DISTINCT entry_id AS qid, unnest({_toks('query')}) AS term FROM (SELECT entry_id, replace(query, '_', ' ') AS query FROM search_eval_qrels WHERE query IS NOT NULL)", "CASE field WHEN 'description' THEN 6.0 WHEN 'name' THEN 12.0 END",
    ) + " SELECT qid, id AS unique_id, round(score, 3) AS score FROM ranked WHERE rank <= 10",
    "postings_stats": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM ({_TEXT})) GROUP BY ALL) GROUP BY 1",
    "ngram_search": _E + f"SELECT unique_id, score FROM (SELECT unique_id, round(len(list_intersect({_NGRAMS.format(c='entity_name')}, {_NGRAMS.format(c=chr(39) + 'invoice_summary' + chr(39))}))::DOUBLE / 13, 6) AS score FROM e WHERE entity_name IS NOT NULL) WHERE score >= 0.4",
    "fuzzy_terms": f"""WITH v AS (SELECT DISTINCT unnest(words) AS m FROM ({_TEXT})), q AS ({_values(["snapshts", "wekly", "ownres", "reconcilation", "key"])})
      SELECT term, m AS match, CAST(levenshtein(term, m) AS INTEGER) AS distance FROM q JOIN v ON regexp_full_match(m, '[ -~]*') AND (levenshtein(term, m) <= CASE WHEN length(term) < 4 THEN 0 WHEN length(term) <= 7 THEN 1 ELSE 2 END
        OR (length(term) BETWEEN 4 AND 7 AND damerau_levenshtein(term, m) = 1))""",
    "phrase_match": f"""WITH w AS (SELECT doc_id, {_toks('text', 1)} AS w FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(len(list_filter(range(1, len(w) - 1), lambda i: w[i:i + 2] = ['the', 'weekly', 'sheets'])) AS BIGINT) AS times FROM w WHERE len(list_filter(range(1, len(w) - 1), lambda i: w[i:i + 2] = ['the', 'weekly', 'sheets'])) > 0""",
    "boolean_search": f"""WITH w AS (SELECT doc_id, {_toks('text', 1)} AS w FROM documents WHERE text IS NOT NULL AND lower(source) = 'runbooks')
      SELECT doc_id, CAST(1 + CAST(list_contains(w, 'weekly') AS INT) + CAST(list_contains(w, 'owners') AS INT) AS INTEGER) AS score FROM w WHERE list_contains(w, 'snapshots') AND NOT list_contains(w, 'buyers')""",
    "suggestions": _E + "SELECT DISTINCT entity_name AS name, round(1 - levenshtein(lower(entity_name), 'dim__calender_day')::DOUBLE / greatest(length(entity_name), 17), 6) AS similarity FROM e ORDER BY similarity DESC, name LIMIT 7",
    "rrf_fusion": _RRF.replace("{w}", "1.0") + " SELECT doc_id, score FROM f",
    "rrf_engineer": _RRF.replace("{w}", "1.5") + """, g AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f)
      SELECT doc_id, score, CAST(rank AS INTEGER) AS rank, coalesce((score - lead(score) OVER (ORDER BY rank)) / score < 0.08, FALSE) AS near_tie FROM g""",
    "rescored": _E + """, o AS (SELECT parent_unique_id AS id, bool_or(canonical) AS canon, bool_or(indicator_type = 'measure') AS m, bool_or(indicator_type = 'metric') AS k FROM indicator_inventory GROUP BY 1),
      h AS (SELECT e.unique_id, e.resource_type AS rt, e.entity_name AS n, (canon IS NOT NULL OR list_contains(coalesce(tags, []), 'mart')) AS hb, coalesce(canon, FALSE) AS c, coalesce(m, FALSE) AS m, coalesce(k, FALSE) AS k, coalesce(list_contains(tags, 'certified'), FALSE) AS s
        FROM e LEFT JOIN o ON o.id = e.unique_id WHERE resource_type IS NOT NULL AND entity_name IS NOT NULL),
      g AS (SELECT *, 0.5::DOUBLE * CASE WHEN regexp_matches(n, '^(stg|base)_') THEN 0.6::DOUBLE ELSE 1 END * CASE rt WHEN 'model' THEN 1.25::DOUBLE WHEN 'source' THEN 1.05::DOUBLE WHEN 'test' THEN 0.65::DOUBLE ELSE 1 END * CASE WHEN hb THEN 1 ELSE 0.93::DOUBLE END
        * CASE WHEN hb AND m THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN hb AND k THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN hb AND s THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN hb AND c THEN 1.08::DOUBLE ELSE 1 END AS v FROM h)
      SELECT unique_id, round(CASE WHEN hb AND c AND (m OR k OR s) THEN v * 1.35::DOUBLE + 2.5::DOUBLE ELSE v END, 6) AS final_score FROM g""",
    "dense_topk": f"SELECT vec_id, round(list_inner_product({_EMB}, {_VECTOR}) / (sqrt(list_inner_product({_EMB}, {_EMB})) * sqrt(list_inner_product({_VECTOR}, {_VECTOR}))), 5) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10",
    "lsh_candidates": "SELECT vec_id, signature FROM (SELECT vec_id, " + " + ".join(
        f"CASE WHEN list_inner_product({_EMB}, [{', '.join(f'{x!r}::DOUBLE' for x in p)}]) >= 0 THEN {1 << i}::BIGINT ELSE 0 END" for i, p in enumerate(PLANES)
    ) + f" AS signature FROM embeddings) WHERE bit_count(xor(signature, {sum(1 << i for i, p in enumerate(PLANES) if sum(a * b for a, b in zip(p, QUERY_VECTOR, strict=True)) >= 0)}::BIGINT)) <= 2",
    "quantised_dot": f"SELECT vec_id, round(list_inner_product([CAST(CAST(round(CAST(x AS DOUBLE) * 127) AS INTEGER) AS DOUBLE) FOR x IN embedding], [{', '.join(str(float(round(x * 127))) + '::DOUBLE' for x in QUERY_VECTOR)}]) / (127 * 127), 4) AS score FROM embeddings",
    "sparse_dot": f"SELECT id AS doc_id, round(sum((1 + ln(tf)) * v), 6) AS score FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM ({_TEXT})) GROUP BY ALL) JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {0.5 + i}::DOUBLE)" for i, w in enumerate(TERMS)) + ") AS q(term, v)) USING (term) GROUP BY id",
    "indicator_inventory": "SELECT indicator_id, indicator_name, canonical, parent_unique_id FROM indicator_inventory WHERE indicator_type = 'metric' ORDER BY canonical DESC NULLS LAST, parent_unique_id NULLS FIRST, indicator_name, indicator_id LIMIT 40 OFFSET 10",
    "column_inventory": "WITH x AS (SELECT 1)" + metadata.PAYLOAD_COLUMNS + " SELECT unique_id, column_name, data_type FROM pc ORDER BY ALL LIMIT 100",
}


def _indicator_sql() -> str:
    asked = "['gross', 'margin', 'of', 'supplier', 'invoice']"
    parts = {"name": "indicator_name", "synonym": "array_to_string(synonyms, ' ')", "field": "field_name", "description": "description", "expression": "expression"}
    cols = ", ".join(f"len(list_filter({asked}, lambda a: list_contains({_toks(chr(99) + 'oalesce(' + c + ', ' + chr(39) * 2 + ')')}, a)))::DOUBLE / 5 AS s_{k}" for k, c in parts.items())
    options = " UNION ALL ".join(f"SELECT indicator_id, canonical, parent_unique_id, '{k}' AS match_type, {p}::DOUBLE + 4 * s_{k} AS v FROM c WHERE s_{k} > 0" for k, p in search.MATCH_POINTS.items())
    return f"""WITH c AS (SELECT indicator_id, canonical, parent_unique_id, {cols} FROM indicator_inventory), o AS ({options}),
      b AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY v DESC, match_type DESC) AS r FROM o),
      i AS (SELECT indicator_id, parent_unique_id, match_type, round(v + CASE WHEN canonical THEN 1 ELSE 0 END, 6) AS score FROM b WHERE r = 1)"""


SQL["indicator_search"] = _indicator_sql() + " SELECT indicator_id, match_type, score FROM i"
SQL["indicator_parents"] = _indicator_sql() + """, t AS (SELECT *, row_number() OVER (PARTITION BY parent_unique_id ORDER BY score DESC, indicator_id) AS r FROM i), s AS (SELECT parent_unique_id, count(*) AS indicators, sum(score) AS total FROM t WHERE r <= 3 GROUP BY 1)
  SELECT parent_unique_id, indicators, round(total / (SELECT max(total) FROM s), 6) AS score FROM s"""
SQL["column_search"] = "WITH x AS (SELECT 1)" + metadata.PAYLOAD_COLUMNS + """, m AS (SELECT *, (list_contains(string_split(lower(column_name), '_'), 'status'))::INT + (list_contains(string_split(lower(column_name), '_'), 'date'))::INT + (list_contains(string_split(lower(column_name), '_'), 'code'))::INT AS n,
  CASE WHEN lower(data_type) IN ('status', 'date', 'code') THEN 1 ELSE 0 END AS t FROM pc) SELECT unique_id, column_name, CASE WHEN n > 0 THEN 'name' ELSE 'type' END AS match_type, CASE WHEN n > 0 THEN 6.0::DOUBLE + n ELSE 4.5::DOUBLE + t END AS score FROM m WHERE n > 0 OR t > 0"""
