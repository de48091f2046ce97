"""Queries of the inventories and the dependency graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.jsonvalue import parse, plain
from metaloom.functions.scores import pii_like
from metaloom.operators import hierarchy, inventory, lineage
from metaloom.queries import problems
from metaloom.session import cut_lineage, table

HUB = "model.core_metrics.dim__calendar_day"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.current(table(spark, sf_dir, "entities"))


def _of_entities(f):
    return lambda spark, sf_dir: f(_entities(spark, sf_dir))


def batch_lookup(spark, sf_dir):
    return inventory.batch_lookup(_entities(spark, sf_dir), table(spark, sf_dir, "parent_map").select("unique_id"))


def find_by_path(spark, sf_dir):
    path = F.concat(F.lit("models/"), F.col("schema_name"), F.lit("/"), F.col("entity_name"), F.lit(".sql"))
    return inventory.find_by_path(_entities(spark, sf_dir), path, "models/f*/stg__*_????.sql")


def layer_counts(spark, sf_dir):
    return _entities(spark, sf_dir).where("resource_type = 'model'").groupBy(inventory.layer(F.col("entity_name")).alias("layer")).agg(F.count("*").alias("models"))


def pii_columns(spark, sf_dir):
    """Declared columns of all entities, and whether their names hint at personal data."""
    return _payload_columns(spark, sf_dir).select("unique_id", "column_name").distinct().select("unique_id", "column_name", pii_like(F.col("column_name")).alias("pii_like"))


def _coverage(spark, sf_dir):
    return inventory.test_coverage(_entities(spark, sf_dir), inventory.attached_tests(table(spark, sf_dir, "tests_by_entity")))


def test_types(spark, sf_dir):
    tests = inventory.attached_tests(table(spark, sf_dir, "tests_by_entity"))
    return tests.groupBy(inventory.test_type(F.element_at(F.split("test_id", r"\."), 3)).alias("test_type")).agg(F.count("*").alias("tests"), F.countDistinct("unique_id").alias("entities"))


def diff_tags(spark, sf_dir):
    """Tags of each entity against those of its dependencies' first parent in id order."""
    e = _entities(spark, sf_dir).select("unique_id", "tags")
    first = lineage.edges(table(spark, sf_dir, "parent_map")).groupBy("child").agg(F.min("parent").alias("parent"))
    a, b = e.alias("a"), e.alias("b")
    j = first.join(a, F.col("child") == F.col("a.unique_id")).join(b, F.col("parent") == F.col("b.unique_id"))
    x, y = F.coalesce("a.tags", F.array().cast("array<string>")), F.coalesce("b.tags", F.array().cast("array<string>"))
    return j.select(
        "child", "parent", F.array_join(F.array_sort(F.array_except(x, y)), ",").alias("only_child"), F.array_join(F.array_sort(F.array_except(y, x)), ",").alias("only_parent"),
        F.array_join(F.array_sort(F.array_intersect(x, y)), ",").alias("both_"),
    )


def _edges(spark, sf_dir):
    return lineage.edges(table(spark, sf_dir, "parent_map"))


def _hub(spark):
    return spark.createDataFrame([(HUB,)], "root string")


def lineage_down(spark, sf_dir):
    return lineage.reach(_edges(spark, sf_dir), _hub(spark), True, None, 3).select("id", "depth")


def lineage_typed(spark, sf_dir):
    """Downstream of the hub, where only snapshots, seeds and tests cost a level."""
    counted = _entities(spark, sf_dir).where("resource_type <> 'model'").select(F.col("unique_id").alias("id"))
    return lineage.reach(_edges(spark, sf_dir), _hub(spark), True, counted, 2).select("id", "depth")


def lineage_up_all(spark, sf_dir):
    """Upstream of every entity, at the operator's full depth."""
    return lineage.reach(_edges(spark, sf_dir), _entities(spark, sf_dir).select(F.col("unique_id").alias("root")), False)


def impact_by_type(spark, sf_dir):
    reached = lineage.reach(_edges(spark, sf_dir), _hub(spark), True, None, 3)
    return lineage.impact(reached, _entities(spark, sf_dir)).select("resource_type", "entities", "score")


def dag_orphans(spark, sf_dir):
    return lineage.orphans(_entities(spark, sf_dir), _edges(spark, sf_dir))


def dag_cycles(spark, sf_dir):
    """Each loop of the hierarchies by its smallest id, with its length."""
    h = hierarchy.hierarchies(table(spark, sf_dir, "cycle_parent_map"), table(spark, sf_dir, "cycle_child_map"))
    return h.where("depth = -1").groupBy("root_id").agg(F.count("*").alias("nodes"))


def _payload_columns(spark, sf_dir):
    """Declared columns of valid payloads: (unique_id, column_name, data_type), names as written."""

    def read(batches):
        for batch in batches:
            out = []
            for uid, text in batch.itertuples(index=False, name=None):
                try:
                    payload = parse(text)
                except ValueError:
                    continue
                held = payload.get("columns") if isinstance(payload, dict) else None
                for name, c in held.items() if isinstance(held, dict) else ():
                    if isinstance(c, dict):
                        out.append((uid, plain(name), plain(c.get("data_type"))))
            yield pd.DataFrame(out, columns=["unique_id", "column_name", "data_type"], dtype=object)

    held = table(spark, sf_dir, "nova_blocks").where("payload_json is not null and unique_id is not null")
    return held.select(F.lower(F.trim("unique_id")).alias("unique_id"), "payload_json").mapInPandas(read, "unique_id string, column_name string, data_type string").distinct()


def _column_matches(spark, sf_dir):
    sources = _entities(spark, sf_dir).where("resource_type = 'source'").select("unique_id")
    return cut_lineage(lineage.column_matches(lineage.column_pairs(_edges(spark, sf_dir), cut_lineage(_payload_columns(spark, sf_dir)), None, sources)))


def column_matches(spark, sf_dir):
    """Column matches along the edges whose both ends declare columns."""
    return _column_matches(spark, sf_dir)


def column_lineage(spark, sf_dir):
    """Downstream of every declared column, over all hops."""
    roots = _payload_columns(spark, sf_dir).select(F.col("unique_id").alias("root"), F.col("column_name").alias("root_column")).distinct()
    return lineage.column_lineage(_column_matches(spark, sf_dir), roots)


def column_lineage_up(spark, sf_dir):
    """Upstream of every declared column, over all hops."""
    roots = _payload_columns(spark, sf_dir).select(F.col("unique_id").alias("root"), F.col("column_name").alias("root_column")).distinct()
    return lineage.column_lineage(_column_matches(spark, sf_dir), roots, False)


def lineage_subgraph(spark, sf_dir):
    """The edges among all that depends on the hub within three levels."""
    reached = lineage.reach(_edges(spark, sf_dir), _hub(spark), True, None, 3)
    return lineage.lineage_edges(reached, _edges(spark, sf_dir), _hub(spark)).select("parent", "child")


def column_references(spark, sf_dir):
    return lineage.column_references(table(spark, sf_dir, "documents"), "status_code")


QUERIES = {
    "entity_counts": _of_entities(inventory.count_by_type), "tag_counts": _of_entities(inventory.count_by_tag), "package_counts": _of_entities(inventory.count_by_package),
    "database_counts": _of_entities(inventory.count_by_database),
    "list_entities": _of_entities(lambda e: inventory.matching(e, "MODEL", None, ["finance", "hourly"], "prod.bookings").select("unique_id", "entity_name", "materialization")),
    "list_entities_page": _of_entities(lambda e: inventory.page(e.select("unique_id", "resource_type"), ["unique_id"], 25, 50)),
    "get_entity": _of_entities(lambda e: inventory.lookup(e, HUB).select("unique_id", "entity_name", "resource_type", "package_name")),
    "batch_get_entities": batch_lookup, "find_by_path": find_by_path, "layer_counts": layer_counts, "pii_columns": pii_columns,
    "test_coverage": _coverage, "test_types": test_types, "coverage_by_package": lambda s, d: inventory.coverage_by_package(_coverage(s, d)),
    "undocumented": _of_entities(inventory.undocumented), "undocumented_page": _of_entities(lambda e: inventory.page(inventory.undocumented(e), ["unique_id"], 20, 10)),
    "diff_tags": diff_tags, "manifest_health": _of_entities(inventory.manifest_health), "text_flags": lambda s, d: inventory.text_flags(table(s, d, "documents")),
    "lineage_edges": _edges, "lineage_down": lineage_down, "lineage_typed": lineage_typed, "lineage_up_all": lineage_up_all, "impact_by_type": impact_by_type,
    "dag_orphans": dag_orphans, "dag_cycles": dag_cycles, "dag_residual_edges": lambda s, d: lineage.on_cycles(_edges(s, d)),
    "column_matches": column_matches, "column_lineage": column_lineage, "column_lineage_up": column_lineage_up, "lineage_subgraph": lineage_subgraph, "column_references": column_references,
}

E = r"""
WITH RECURSIVE raw AS (SELECT *, lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) AS id FROM entities WHERE regexp_matches(unique_id, '\S')),
e AS (SELECT id AS unique_id, resource_type, entity_name, package_name, database_name, schema_name, materialization, description, tags, created_at, deleted_at
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, resource_type DESC NULLS LAST, entity_name DESC NULLS LAST, package_name DESC NULLS LAST, database_name DESC NULLS LAST,
    schema_name DESC NULLS LAST, materialization DESC NULLS LAST, description DESC NULLS LAST) AS r FROM raw) WHERE r = 1)
"""
G = (
    E
    + r""", pm AS (SELECT unique_id AS c, unnest(parent_ids) AS p FROM parent_map WHERE regexp_matches(unique_id, '\S')),
edge AS (SELECT DISTINCT lower(regexp_replace(c, '^\s+|\s+$', '', 'g')) AS child, lower(regexp_replace(p, '^\s+|\s+$', '', 'g')) AS parent FROM pm WHERE regexp_matches(p, '\S'))
"""
)
T = (
    E
    + r""", tm AS (SELECT unique_id AS c, unnest(test_ids) AS t FROM tests_by_entity WHERE regexp_matches(unique_id, '\S')),
tt AS (SELECT *, coalesce(nullif(regexp_extract(string_split(test_id, '.')[3], '^(not_null|unique|accepted_values|relationships)_', 1), ''), 'custom') AS kind FROM
  (SELECT DISTINCT lower(regexp_replace(c, '^\s+|\s+$', '', 'g')) AS unique_id, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS test_id FROM tm WHERE regexp_matches(t, '\S'))),
cov AS (SELECT e.unique_id, e.package_name, e.resource_type, count(tt.test_id) AS tests, count(*) FILTER (WHERE tt.kind <> 'custom') AS generic_tests,
  count(*) FILTER (WHERE tt.kind = 'custom') AS custom_tests, coalesce(string_agg(DISTINCT tt.kind, ',' ORDER BY tt.kind), '') AS types
  FROM e LEFT JOIN tt ON e.unique_id = tt.unique_id WHERE e.resource_type IN ('model', 'seed', 'snapshot', 'source') GROUP BY 1, 2, 3)
"""
)
DOWN = G + f", down AS (SELECT '{HUB}' AS id, 0 AS depth UNION SELECT edge.child, depth + 1 FROM down JOIN edge ON edge.parent = down.id WHERE depth < 3), d AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM down WHERE depth > 0 GROUP BY id)"
PAYLOAD_COLUMNS = """, pj AS (SELECT block_id, unique_id, CAST(payload_json AS JSON) AS p FROM nova_blocks WHERE json_valid(payload_json)),
  px AS (SELECT block_id, unique_id, name, json_extract(p, '$.columns."' || name || '"') AS c FROM (SELECT *, unnest(json_keys(p, '$.columns')) AS name FROM pj WHERE json_type(p, '$.columns') = 'OBJECT')),
  pc AS (SELECT DISTINCT lower(trim(unique_id)) AS unique_id, name AS column_name, c->>'$.data_type' AS data_type FROM px WHERE json_type(c) = 'OBJECT' AND unique_id IS NOT NULL)"""

_MATCHES = G + PAYLOAD_COLUMNS + r""", fam AS (SELECT *, CASE WHEN regexp_matches(lower(data_type), 'date|time|timestamp|interval') THEN 't' WHEN regexp_matches(lower(data_type), 'int|num|dec|float|double|real|money|serial') THEN 'n'
    WHEN regexp_matches(lower(data_type), 'char|text|string|varchar|clob') THEN 's' END AS family FROM pc),
  pairs AS (SELECT child, parent, a.column_name AS source_column, a.data_type AS source_type, b.column_name AS target_column, b.data_type AS target_type, lower(a.column_name) AS x, lower(b.column_name) AS y, coalesce(s.resource_type = 'source', FALSE) AS src
    FROM edge JOIN fam a ON a.unique_id = parent JOIN fam b ON b.unique_id = child LEFT JOIN e s ON s.unique_id = parent WHERE lower(a.data_type) = lower(b.data_type) OR a.family = b.family OR coalesce(a.data_type, '') = '' OR coalesce(b.data_type, '') = ''),
  scored AS (SELECT *, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS sim, regexp_replace(x, '[^a-z0-9]', '', 'g') AS nx, regexp_replace(y, '[^a-z0-9]', '', 'g') AS ny, regexp_split_to_array(x, '\.|__')[-1] AS lx, regexp_split_to_array(y, '\.|__')[-1] AS ly FROM pairs),
  opts AS (SELECT *, list_filter([
      CASE WHEN x = y THEN {'score': 1.0::DOUBLE, 'match_type': 'exact_match', 'confidence': 'high'} END,
      CASE WHEN src AND regexp_replace(x, '^[a-z]+_', '') = y AND x <> y THEN {'score': 0.64::DOUBLE, 'match_type': 'source_match', 'confidence': 'medium'} END,
      CASE WHEN x <> y AND lx = ly AND strlen(lx) >= 3 AND (contains(x || y, '.') OR contains(x || y, '__')) THEN {'score': 0.3::DOUBLE, 'match_type': 'nested_match', 'confidence': 'low'} END,
      CASE WHEN strlen(x) >= 2 AND strlen(y) >= 2 AND (ends_with(y, x) OR ends_with(x, y)) THEN {'score': 0.24::DOUBLE, 'match_type': 'suffix_match', 'confidence': 'low'} END,
      CASE WHEN strlen(x) >= 2 AND strlen(y) >= 2 AND (starts_with(y, x) OR starts_with(x, y)) THEN {'score': 0.24::DOUBLE, 'match_type': 'prefix_match', 'confidence': 'low'} END,
      CASE WHEN nx <> '' AND nx = ny THEN {'score': 0.275::DOUBLE, 'match_type': 'normalized_match', 'confidence': 'low'} END,
      CASE WHEN strlen(x) >= 3 AND strlen(y) >= 3 AND sim >= 0.75 THEN {'score': 0.6::DOUBLE * sim, 'match_type': 'levenshtein_match', 'confidence': 'low'} END], lambda o: o IS NOT NULL) AS o FROM scored),
  mm AS (SELECT child, parent, source_column, source_type, target_column, target_type, b.match_type, b.confidence, round(b.score, 6) AS score FROM (SELECT *, list_sort(o, 'DESC')[1] AS b FROM opts WHERE len(o) > 0))"""
_CHAIN = """, st AS (SELECT {at} AS at, lower({atc}) AS atc, {to} AS uid, lower({toc}) AS col, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS c, score AS s FROM mm WHERE CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END >= {least}),
  rt AS (SELECT DISTINCT unique_id AS root, lower(column_name) AS rc FROM pc),
  lv0 AS (SELECT root, rc, root AS uid, rc AS col, 0 AS depth, 1.0::DOUBLE AS score, 2 AS c FROM rt),
  way AS (SELECT * FROM lv0 UNION SELECT way.root, way.rc, st.uid, st.col, way.depth + 1, way.score * st.s, least(way.c, st.c) FROM way JOIN st ON st.at = way.uid AND st.atc = way.col WHERE way.depth < 10 AND NOT (st.uid = way.root AND st.col = way.rc)),
  far AS (SELECT *, min(depth) OVER (PARTITION BY root, rc, uid, col) AS least_depth FROM way WHERE depth > 0),
  one AS (SELECT root, rc, uid, col, depth, max({{'score': score, 'c': c}}) AS b FROM far WHERE depth = least_depth GROUP BY ALL)
  SELECT root, rc AS root_column, uid AS unique_id, col AS column_name, CAST(depth AS INTEGER) AS depth, ['low', 'medium', 'high'][b.c + 1] AS confidence, round(b.score, 6) AS score FROM one"""
_LOOPS = problems._TREE + "SELECT least AS root_id, count(*) AS nodes FROM loop_end WHERE on_loop GROUP BY 1"

SQL = {
    "dag_cycles": _LOOPS,
    "entity_counts": E + "SELECT resource_type, count(*) AS entities FROM e GROUP BY 1",
    "tag_counts": E + "SELECT tag, count(DISTINCT unique_id) AS entities FROM (SELECT unique_id, unnest(tags) AS tag FROM e) WHERE tag IS NOT NULL GROUP BY 1",
    "package_counts": E + "SELECT coalesce(package_name, '') AS package_name, count(*) AS entities FROM e GROUP BY 1",
    "database_counts": E + "SELECT concat_ws('.', nullif(database_name, ''), nullif(schema_name, '')) AS location, count(*) AS entities FROM e WHERE coalesce(nullif(database_name, ''), nullif(schema_name, '')) IS NOT NULL GROUP BY 1",
    "list_entities": E + "SELECT unique_id, entity_name, materialization FROM e WHERE lower(resource_type) = 'model' AND list_contains(tags, 'finance') AND list_contains(tags, 'hourly') AND database_name || '.' || schema_name = 'prod.bookings'",
    "list_entities_page": E + "SELECT unique_id, resource_type FROM e ORDER BY unique_id LIMIT 25 OFFSET 50",
    "get_entity": E + f"SELECT unique_id, entity_name, resource_type, package_name FROM e WHERE unique_id = '{HUB}'",
    "batch_get_entities": E + r", a AS (SELECT DISTINCT lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) AS unique_id FROM parent_map WHERE regexp_matches(unique_id, '\S')) SELECT a.unique_id, e.unique_id IS NOT NULL AS found, e.entity_name, e.resource_type FROM a LEFT JOIN e ON a.unique_id = e.unique_id",
    "find_by_path": E + "SELECT 'models/' || schema_name || '/' || entity_name || '.sql' AS path, unique_id FROM e WHERE regexp_full_match('models/' || schema_name || '/' || entity_name || '.sql', 'models/f[^/]*/stg__[^/]*_[^/]{4}[.]sql')",
    "layer_counts": E + "SELECT CASE WHEN regexp_matches(lower(trim(entity_name)), '^(stg_|stage_)') THEN 'staging' WHEN regexp_matches(lower(trim(entity_name)), '^(int_|intermediate_)') THEN 'intermediate' WHEN regexp_matches(lower(trim(entity_name)), '^mart_') THEN 'mart' END AS layer, count(*) AS models FROM e WHERE resource_type = 'model' GROUP BY 1",
    "pii_columns": "WITH x AS (SELECT 1)" + PAYLOAD_COLUMNS + r" SELECT DISTINCT unique_id, column_name, regexp_matches(regexp_replace(lower(trim(column_name)), '[- ]', '_', 'g'), '(^|_)(email|phone|address|full_name|first_name|last_name|date_of_birth)(_|$)') AS pii_like FROM pc",
    "test_coverage": T + "SELECT * FROM cov",
    "test_types": T + "SELECT kind AS test_type, count(*) AS tests, count(DISTINCT unique_id) AS entities FROM tt GROUP BY 1",
    "coverage_by_package": T + "SELECT package_name, count(*) AS entities, count(*) FILTER (WHERE tests > 0) AS tested, round(100.0::DOUBLE * count(*) FILTER (WHERE tests > 0) / count(*), 2) AS coverage_pct FROM cov GROUP BY 1",
    "undocumented": E + "SELECT unique_id, resource_type, package_name FROM e WHERE trim(coalesce(description, '')) = ''",
    "undocumented_page": E + "SELECT unique_id, resource_type, package_name FROM e WHERE trim(coalesce(description, '')) = '' ORDER BY unique_id LIMIT 20 OFFSET 10",
    "diff_tags": G + """, f AS (SELECT child, min(parent) AS parent FROM edge GROUP BY child), j AS (SELECT child, parent, coalesce(a.tags, []) AS x, coalesce(b.tags, []) AS y FROM f JOIN e a ON a.unique_id = child JOIN e b ON b.unique_id = parent)
      SELECT child, parent, array_to_string(list_sort(list_distinct([t for t in x if NOT list_contains(y, t)])), ',') AS only_child, array_to_string(list_sort(list_distinct([t for t in y if NOT list_contains(x, t)])), ',') AS only_parent,
      array_to_string(list_sort(list_distinct([t for t in x if list_contains(y, t)])), ',') AS both_ FROM j""",
    "manifest_health": E + """SELECT count(*) AS entities, count(*) FILTER (WHERE trim(coalesce(description, '')) = '') AS undocumented, count(*) FILTER (WHERE materialization IS NULL AND resource_type = 'model') AS models_without_materialization,
      count(*) FILTER (WHERE len(coalesce(tags, [])) = 0) AS untagged, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted FROM e""",
    "lineage_edges": G + "SELECT child, parent FROM edge",
    "lineage_down": DOWN + " SELECT id, depth FROM d",
    "lineage_typed": G + f""", step AS (SELECT parent, child, CASE WHEN e.unique_id IS NULL THEN 0 ELSE 1 END AS cost FROM edge LEFT JOIN e ON e.unique_id = child AND e.resource_type <> 'model'),
      down AS (SELECT '{HUB}' AS id, 0 AS depth UNION SELECT step.child, depth + cost FROM down JOIN step ON step.parent = down.id WHERE depth + cost <= 2)
      SELECT child AS id, CAST(min(depth + cost) AS INTEGER) AS depth FROM down JOIN step ON step.parent = down.id WHERE depth + cost <= 2 GROUP BY 1""",
    "lineage_up_all": G + r""", up AS (SELECT unique_id AS root, unique_id AS id, 0 AS depth FROM e UNION SELECT root, edge.parent, depth + 1 FROM up JOIN edge ON edge.child = up.id WHERE depth < 200)
      SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM up WHERE depth > 0 GROUP BY root, id""",
    "impact_by_type": DOWN + ", t AS (SELECT resource_type, count(*) AS entities FROM d JOIN e ON e.unique_id = d.id GROUP BY 1) SELECT resource_type, entities, CAST((SELECT sum(entities) FROM t) AS BIGINT) AS score FROM t",
    "lineage_subgraph": DOWN + f", nd AS (SELECT id FROM d UNION SELECT '{HUB}') SELECT parent, child FROM edge WHERE parent IN (SELECT id FROM nd) AND child IN (SELECT id FROM nd)",
    "text_flags": r"SELECT doc_id, regexp_matches(text, '\{\{|\{%|\{#') AS templated, len(regexp_extract_all(text, 'ref\(')) > len(regexp_extract_all(text, 'ref\([^()\n]*\)')) AS malformed_ref FROM documents WHERE text IS NOT NULL",
    "dag_residual_edges": G + r""", up AS (SELECT child AS root, parent AS id FROM edge UNION SELECT root, edge.parent FROM up JOIN edge ON edge.child = up.id), cyc AS (SELECT root AS id FROM up WHERE root = id),
      above AS (SELECT id FROM cyc UNION SELECT root FROM up WHERE id IN (SELECT id FROM cyc)), below AS (SELECT id FROM cyc UNION SELECT id FROM up WHERE root IN (SELECT id FROM cyc))
      SELECT child, parent FROM edge WHERE parent IN (SELECT id FROM above) AND child IN (SELECT id FROM below)""",
    "dag_orphans": G + "SELECT unique_id, resource_type FROM e WHERE unique_id NOT IN (SELECT child FROM edge) AND unique_id NOT IN (SELECT parent FROM edge)",
    "column_matches": _MATCHES + " SELECT child, parent, source_column, source_type, target_column, target_type, match_type, confidence, score FROM mm",
    "column_lineage": _MATCHES + _CHAIN.format(at="parent", atc="source_column", to="child", toc="target_column", least=0),
    "column_lineage_up": _MATCHES + _CHAIN.format(at="child", atc="target_column", to="parent", toc="source_column", least=0),
    "column_references": r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\bstatus_code\b')) AS INTEGER) AS times FROM documents WHERE regexp_matches(lower(text), '\bstatus_code\b')",
}
