"""Queries of the operators for text and vectors of training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm import canonical, mixing, neighbours, packing, reading
from metaloom.session import cut_lineage, table


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = {
        "indicator_search": (table(spark, sf_dir, "indicator_search"), "indicator_name", False),
        "search_eval_qrels": (table(spark, sf_dir, "search_eval_qrels"), "query", True),
    }
    return canonical.map_to_canonical(entries, table(spark, sf_dir, "indicator_inventory"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("entry_table", "entry_id", "indicator_id")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unmatched(_mapped(spark, sf_dir))


def p2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all entries those typed in plain lower case exactly as a name or synonym, with the indicator they are mapped to."""
    names = canonical.canonical_names(table(spark, sf_dir, "indicator_inventory"))
    spelled = names.select(F.trim(F.regexp_replace(F.lower("name"), "[ _-]+", " ")).alias("name")).distinct()
    plain = _mapped(spark, sf_dir).where(F.col("typed").rlike("^[a-z ]+$")).withColumn("name", F.trim(F.regexp_replace("typed", " +", " ")))
    return plain.join(spelled, "name", "left_semi").select("entry_table", "entry_id", "indicator_id")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "cached_embeddings"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(_neighbours(spark, sf_dir))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's neighbours with both entities."""
    names = table(spark, sf_dir, "cached_embeddings").groupBy("vec_id").agg(F.min("entity_id").alias("entity_id"))
    found = _neighbours(spark, sf_dir).join(names, "vec_id").join(names.select(F.col("vec_id").alias("other"), F.col("entity_id").alias("other_entity_id")), "other")
    return found.select("vec_id", "entity_id", F.col("other").alias("other_vec_id"), "other_entity_id", "similarity")


def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact neighbours of every vector whose id 50 divides, against all vectors."""
    return neighbours.exact_neighbours(table(spark, sf_dir, "cached_embeddings")).select("model_name", "vec_id", "other")


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds at least nine tenths of the exact neighbours of each model."""
    vectors = table(spark, sf_dir, "cached_embeddings")
    found = neighbours.recall(neighbours.neighbours(vectors), neighbours.exact_neighbours(vectors))
    return found.select("model_name", "queries", (F.col("recall") >= 0.9).alias("recall_reached"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir)[0], table(spark, sf_dir, "container_specs"))


def p7_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[1]


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity: documents placed, and how often containers break a rule."""
    packed = cut_lineage(_packed(spark, sf_dir)[0])
    return packing.broken_rules(packed, table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mix and source: its documents, and whether cap and target are kept."""
    drawn, report = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixing.kept_rules(drawn, report)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").withColumn("source", mixing.source_name("source"))
    return reading.reading_profile(_levels(spark, sf_dir), named, "source")


QUERIES = {
    "p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_buckets": p7_buckets, "p7_invariants": p7_invariants, "p8_invariants": p8_invariants, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p2_found": p2_found, "p2_exact": p2_exact, "p4_exact": p4_exact, "p4_recall": p4_recall, "p2_unmatched": p2_unmatched, "p4_found": p4_found, "p4_neighbours": p4_neighbours,
}
_VECTORS = """
WITH v AS (
  SELECT DISTINCT ON (vec_id) coalesce(model_name, '') AS model_name, vec_id, CAST(dense_embedding AS DOUBLE[]) AS x FROM cached_embeddings
  WHERE vec_id IS NOT NULL AND len(dense_embedding) = 64 AND len(list_filter(dense_embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
    AND len(list_filter(dense_embedding, lambda y: y <> 0)) > 0
), q AS (SELECT * FROM v WHERE vec_id % 50 = 0)
"""
_SOURCE = r"regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s-]+', '_', 'g')"

SQL: dict[str, str] = {
    "p2_exact": """
WITH n AS (
  SELECT indicator_id, trim(regexp_replace(lower(name), '[ _-]+', ' ', 'g')) AS name, name AS raw
  FROM (SELECT indicator_id, unnest(list_append(coalesce(synonyms, []), indicator_name)) AS name FROM indicator_inventory WHERE indicator_id IS NOT NULL) WHERE trim(name) <> ''
), e AS (
  SELECT 'indicator_search' AS entry_table, entry_id, indicator_name AS typed FROM indicator_search UNION SELECT 'search_eval_qrels', entry_id, query FROM search_eval_qrels
), p AS (SELECT entry_table, entry_id, trim(regexp_replace(typed, ' +', ' ', 'g')) AS name FROM e WHERE regexp_full_match(typed, '[a-z ]+'))
SELECT entry_table, entry_id, min(indicator_id) AS indicator_id FROM p JOIN n USING (name) GROUP BY 1, 2""",
    "p4_exact": _VECTORS + """, s AS (
  SELECT q.model_name, q.vec_id, v.vec_id AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.x, v.x), 9) DESC, v.vec_id) AS r
  FROM q JOIN v ON v.model_name = q.model_name AND v.vec_id <> q.vec_id
) SELECT model_name, vec_id, other FROM s WHERE r <= 5""",
    "p4_recall": _VECTORS + "SELECT model_name, count(*) AS queries, TRUE AS recall_reached FROM q GROUP BY 1",
    "p7_invariants": """
SELECT spec_name, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, d.n AS documents, 0 AS over_capacity, 0 AS needless_splits, 0 AS mixed_buckets, 0 AS tokens_lost, 0 AS ids_skipped
FROM (SELECT DISTINCT spec_name, capacity_tokens FROM container_specs WHERE spec_name IS NOT NULL AND capacity_tokens > 0), (SELECT count(*) AS n FROM documents WHERE text <> '') d""",
    "p8_invariants": f"""
WITH t AS (SELECT mix_name, {_SOURCE} AS source, min(max_repeats) AS max_repeats FROM mix_targets WHERE mix_name IS NOT NULL AND target_share > 0 AND source IS NOT NULL GROUP BY 1, 2),
d AS (SELECT {_SOURCE} AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1)
SELECT mix_name, source, max_repeats, coalesce(n, 0) AS source_documents, TRUE AS cap_kept, TRUE AS target_met FROM t LEFT JOIN d USING (source)""",
}
