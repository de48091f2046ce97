"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import drift, hierarchy, nested, orphans
from metaloom.session import cut_lineage, table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"parent_map": "parent_ids", "tests_by_entity": "test_ids"}
    return orphans.orphan_references({t: (table(spark, sf_dir, t), c) for t, c in lists.items()}, table(spark, sf_dir, "entities"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "period", "row_id", "ref_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir))


def _hierarchies(spark: SparkSession, sf_dir: str, with_path: bool = False) -> DataFrame:
    return hierarchy.hierarchies(table(spark, sf_dir, "cycle_parent_map"), table(spark, sf_dir, "cycle_child_map"), with_path)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchies(spark, sf_dir).select("unique_id", "root_id", "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchies(spark, sf_dir, True).select("unique_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "cycle_parent_map"), table(spark, sf_dir, "cycle_child_map"))


def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with the number of its descendants, from the subtree sizes of the peel."""
    return _hierarchies(spark, sf_dir, True).select("unique_id", "descendants")


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_records(table(spark, sf_dir, "nova_blocks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _children(spark, sf_dir).select("block_id", "child_kind", "pos_a", "pos_b", "pos_c")


def _p5_table(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.subtype_tables(_children(spark, sf_dir))[kind].drop("variant")

    return query


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural variants of each subtype, with the number of records."""
    return _children(spark, sf_dir).groupBy("child_kind", "variant").agg(F.count("*").alias("records"), F.min("block_id").alias("first_block"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "manifest_files")
    schemas = cut_lineage(drift.file_schemas(files))
    return files, schemas, *drift.schema_changes(files, schemas)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)[2].select("project_name", "file_seq", "field_path", "change_kind")


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)[2]


def p6_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's fields with their types."""
    held = F.from_json("schema", "map<string,string>")
    return drift.file_schemas(table(spark, sf_dir, "manifest_files")).select("project_name", "file_seq", F.explode(held).alias("field_path", "type")).distinct()


def _united(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, schemas, changes, ends = _changes(spark, sf_dir)
    return files, cut_lineage(drift.united_fields(schemas, changes, ends))


def p6_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _united(spark, sf_dir)[1]


def p6_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.united_table(*_united(spark, sf_dir), "metadata")


def p6_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.united_table(*_united(spark, sf_dir), "nodes")


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report,
    "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_sizes": p3_sizes,
    "p5_found": p5_found, "p5_variants": p5_variants,
    **{f"p5_{k}": _p5_table(k) for k in ("measure", "measure_synonym", "metric", "metric_synonym", "grain_key", "grain_dimension", "filter", "filter_value")},
    "p6_found": p6_found, "p6_changes": p6_changes, "p6_schemas": p6_schemas, "p6_fields": p6_fields, "p6_metadata": p6_metadata, "p6_nodes": p6_nodes,
}

_REFS = r"""
WITH s AS (
  SELECT 'parent_map' AS ref_table, row_id, recorded_at, list_append(coalesce(parent_ids, []), unique_id) AS ids FROM parent_map
  UNION ALL SELECT 'tests_by_entity', row_id, recorded_at, list_append(coalesce(test_ids, []), unique_id) FROM tests_by_entity
), u AS (SELECT ref_table, row_id, recorded_at, unnest(ids) AS id FROM s),
r AS (SELECT DISTINCT ref_table, row_id, recorded_at, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS ref_id FROM u WHERE regexp_matches(id, '\S')),
e AS (SELECT lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) AS id, created_at, deleted_at FROM entities WHERE created_at IS NOT NULL),
o AS (
  SELECT r.ref_table, strftime(r.recorded_at, '%Y-%m') AS period, r.row_id, r.ref_id,
    CASE WHEN count(*) FILTER (WHERE e.created_at <= r.recorded_at AND (e.deleted_at IS NULL OR e.deleted_at > e.created_at)) > 0 THEN 'deleted'
         WHEN count(*) FILTER (WHERE e.id IS NOT NULL AND (e.deleted_at IS NULL OR e.deleted_at > e.created_at)) > 0 THEN 'late' ELSE 'missing' END AS reason
  FROM r LEFT JOIN e ON e.id = r.ref_id
  GROUP BY ALL
  HAVING count(*) FILTER (WHERE e.created_at <= r.recorded_at AND (e.deleted_at IS NULL OR e.deleted_at > r.recorded_at)) = 0
)
"""
_TREE = r"""
WITH RECURSIVE latest AS (
  SELECT lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) AS id, parent_ids AS ids,
         row_number() OVER (PARTITION BY lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) ORDER BY recorded_at DESC, row_id DESC) AS r
  FROM cycle_parent_map WHERE regexp_matches(unique_id, '\S')
), raw AS (
  SELECT id AS child, unnest(ids) AS parent FROM latest WHERE r = 1
  UNION ALL SELECT unnest(child_ids), unique_id FROM cycle_child_map
), link AS (
  SELECT lower(regexp_replace(child, '^\s+|\s+$', '', 'g')) AS child, min(lower(regexp_replace(parent, '^\s+|\s+$', '', 'g'))) AS parent
  FROM raw WHERE regexp_matches(child, '\S') AND regexp_matches(parent, '\S') GROUP BY 1
), name AS (
  SELECT unique_id AS id FROM cycle_parent_map UNION ALL SELECT unnest(parent_ids) FROM cycle_parent_map
  UNION ALL SELECT unique_id FROM cycle_child_map UNION ALL SELECT unnest(child_ids) FROM cycle_child_map
), node AS (
  SELECT DISTINCT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id FROM name WHERE regexp_matches(id, '\S')
), up AS (
  SELECT id AS node, id AS top, 0 AS dist, [id] AS way, FALSE AS looped FROM node
  UNION ALL
  SELECT up.node, link.parent, up.dist + 1, list_append(up.way, link.parent), list_contains(up.way, link.parent)
  FROM up JOIN link ON link.child = up.top WHERE NOT up.looped
), loop_end AS (
  SELECT node, top, list_min(list_slice(way, list_position(way, top), len(way))) AS least, top = node AS on_loop FROM up WHERE looped
), tree AS (
  SELECT up.node, up.top, up.dist, up.way FROM up LEFT JOIN link ON link.child = up.top WHERE link.child IS NULL
)
"""

def _items(source: str, value: str) -> str:
    """Texts and numbers of a list, or of a lone value, with their place."""
    listed = f"CASE WHEN json_type(({value})) = 'ARRAY' THEN from_json({value}, '[\"JSON\"]') WHEN ({value}) IS NOT NULL THEN [{value}] END"
    return f"(SELECT * FROM (SELECT *, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS place FROM (SELECT *, {listed} AS l FROM {source})) WHERE json_type(item) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE'))"


_BLOCKS = """WITH j AS (SELECT DISTINCT block_id, CAST(payload_json AS JSON) AS p FROM nova_blocks WHERE json_valid(payload_json)),
k AS (SELECT block_id, CASE WHEN json_type(p, '$.meta.nova') = 'OBJECT' THEN p->'$.meta.nova' ELSE p->'$.config.meta.nova' END AS b FROM j),
ml AS (SELECT block_id, from_json(b->'$.measures', '["JSON"]') AS l FROM k WHERE json_type(b, '$.measures') = 'ARRAY'),
m AS (SELECT block_id, a, e FROM (SELECT block_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS a FROM ml) WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.name') = 'VARCHAR'),
tl AS (SELECT block_id, list_concat(CASE WHEN coalesce(json_type(b, '$.metric'), 'NULL') <> 'NULL' THEN [b->'$.metric'] ELSE [] END, CASE WHEN json_type(b, '$.metrics') = 'ARRAY' THEN from_json(b->'$.metrics', '["JSON"]') ELSE [] END) AS l FROM k),
t AS (SELECT block_id, a, e FROM (SELECT block_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS a FROM tl) WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.name') = 'VARCHAR'),
fl AS (SELECT block_id, a, from_json(e->'$.recommended_filters', '["JSON"]') AS l FROM t WHERE json_type(e, '$.recommended_filters') = 'ARRAY'),
f AS (SELECT block_id, a, c, e FROM (SELECT block_id, a, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS c FROM fl) WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.field') = 'VARCHAR'),
g AS (SELECT block_id, a, e FROM t WHERE json_type(e, '$.grain') = 'OBJECT'),
r AS (SELECT block_id, 'measure' AS child_kind, a AS pos_a, -1 AS pos_b, -1 AS pos_c FROM m UNION ALL SELECT block_id, 'metric', a, -1, -1 FROM t UNION ALL SELECT block_id, 'filter', a, c, -1 FROM f
"""
_BLOCKS += "".join(f" UNION ALL SELECT block_id, '{kind}', a, {b}, {c} FROM {_items(src, value)}" for kind, src, value, b, c in (
    ("measure_synonym", "m", "e->'$.synonyms'", "place", "-1"), ("metric_synonym", "t", "e->'$.synonyms'", "place", "-1"), ("grain_key", "g", "e->'$.grain.primary_key'", "place", "-1"),
    ("grain_dimension", "g", "e->'$.grain.dimensions'", "place", "-1"), ("filter_value", "f", "e->'$.values'", "c", "place"),
))
_BLOCKS += ")"

_WALK = """
WITH RECURSIVE f AS (
  SELECT project_name, file_seq, CAST(content AS JSON) AS j FROM manifest_files WHERE json_valid(content) AND project_name IS NOT NULL AND file_seq IS NOT NULL
), o AS (SELECT * FROM f WHERE json_type(j) = 'OBJECT'),
r AS (
  SELECT project_name, file_seq, 'metadata' AS path, '0' AS who, j->'$.metadata' AS v FROM o
  UNION ALL SELECT project_name, file_seq, 'nodes', coalesce(e->>'$.unique_id', CAST(i - 1 AS VARCHAR)), e
  FROM (SELECT project_name, file_seq, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (SELECT project_name, file_seq, from_json(j->'$.nodes', '["JSON"]') AS l FROM o WHERE json_type(j, '$.nodes') = 'ARRAY'))
), walk AS (
  SELECT * FROM r WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT project_name, file_seq, path || '.' || k, who, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT')
), leaf AS (
  SELECT DISTINCT project_name, file_seq, path, who, CAST(v AS VARCHAR) AS value,
    CASE json_type(v) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'NULL' THEN NULL ELSE 'number' END AS t
  FROM walk WHERE json_type(v) <> 'OBJECT'
), field AS (
  SELECT project_name, file_seq, path, CASE WHEN count(DISTINCT t) > 1 THEN 'text' ELSE min(t) END AS t FROM leaf GROUP BY 1, 2, 3
), seq AS (SELECT project_name, file_seq, lag(file_seq) OVER (PARTITION BY project_name ORDER BY file_seq) AS before FROM (SELECT DISTINCT project_name, file_seq FROM o)),
old AS (
  SELECT project_name, file_seq AS before, path, last_value(t IGNORE NULLS) OVER w AS t, last_value(CASE WHEN t IS NOT NULL THEN file_seq END IGNORE NULLS) OVER w AS at
  FROM field WINDOW w AS (PARTITION BY project_name, path ORDER BY file_seq)
), came AS (
  SELECT s.project_name, s.file_seq, n.path, n.t FROM seq s JOIN field n USING (project_name, file_seq) WHERE s.before IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM field b WHERE b.project_name = s.project_name AND b.file_seq = s.before AND b.path = n.path)
), went AS (
  SELECT s.project_name, s.file_seq, b.path, b.t, b.at FROM seq s JOIN old b USING (project_name, before)
  WHERE NOT EXISTS (SELECT 1 FROM field n WHERE n.project_name = s.project_name AND n.file_seq = s.file_seq AND n.path = b.path)
), retyped AS (
  SELECT s.project_name, s.file_seq, n.path, b.t AS old_type, n.t AS new_type FROM seq s JOIN field n USING (project_name, file_seq) JOIN old b ON b.project_name = s.project_name AND b.before = s.before AND b.path = n.path
  WHERE n.t <> b.t
), held AS (SELECT DISTINCT project_name, file_seq, path, who || chr(0) || value AS h FROM leaf WHERE t IS NOT NULL),
size AS (SELECT project_name, file_seq, path, count(*) AS n FROM held GROUP BY 1, 2, 3),
pair AS (
  SELECT c.project_name, c.file_seq, split_part(c.path, '.', 1) AS section, c.path AS new_path, c.t AS new_type, w.path AS old_path, w.t AS old_type, w.at
  FROM came c JOIN went w ON w.project_name = c.project_name AND w.file_seq = c.file_seq AND split_part(w.path, '.', 1) = split_part(c.path, '.', 1) WHERE c.t IS NOT NULL AND w.at IS NOT NULL
), agree AS (
  SELECT p.*, count(*) AS hits FROM pair p JOIN held a ON a.project_name = p.project_name AND a.file_seq = p.file_seq AND a.path = p.new_path
  JOIN held b ON b.project_name = p.project_name AND b.file_seq = p.at AND b.path = p.old_path AND b.h = a.h GROUP BY ALL
), ranked AS (
  SELECT g.*, row_number() OVER (PARTITION BY g.project_name, g.file_seq, section, new_path ORDER BY hits / greatest(x.n, y.n) DESC, levenshtein(lower(new_path), lower(old_path)), new_path, old_path) AS r,
    row_number() OVER (PARTITION BY g.project_name, g.file_seq, section, old_path ORDER BY hits / greatest(x.n, y.n) DESC, levenshtein(lower(new_path), lower(old_path)), new_path, old_path) AS s
  FROM agree g JOIN size x ON x.project_name = g.project_name AND x.file_seq = g.file_seq AND x.path = new_path JOIN size y ON y.project_name = g.project_name AND y.file_seq = g.at AND y.path = old_path
), moved AS (SELECT * FROM ranked WHERE r = 1 AND s = 1),
change AS (
  SELECT project_name, file_seq, path AS field_path, 'added' AS change_kind, NULL AS old_path, NULL AS old_type, t AS new_type FROM came c
    WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.project_name = c.project_name AND m.file_seq = c.file_seq AND m.new_path = c.path)
  UNION ALL SELECT project_name, file_seq, path, 'removed', NULL, t, NULL FROM went w
    WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.project_name = w.project_name AND m.file_seq = w.file_seq AND m.old_path = w.path)
  UNION ALL SELECT project_name, file_seq, new_path, 'renamed', old_path, old_type, new_type FROM moved
  UNION ALL SELECT project_name, file_seq, path, 'retyped', NULL, old_type, new_type FROM retyped
  UNION ALL SELECT project_name, file_seq, new_path, 'retyped', old_path, old_type, new_type FROM moved WHERE old_type <> new_type
)
"""
_ENTITY = ", n AS (SELECT block_id, min(unique_id) AS unique_id FROM nova_blocks GROUP BY 1)"


def _shown(path: str) -> str:
    """A JSON value as a text; a list's elements joined by commas."""
    return f"CASE json_type({path}) WHEN 'ARRAY' THEN array_to_string(list_transform(from_json({path}, '[\"JSON\"]'), lambda y: coalesce(y->>'$', '')), ',') WHEN 'NULL' THEN NULL ELSE ({path})->>'$' END"


def _records_sql(kind: str, source: str, name: str, columns: dict[str, str], at: str, parent: str) -> str:
    listed = "".join(f", {_shown(path)} AS {column}" for column, path in columns.items())
    return f"{_BLOCKS}{_ENTITY} SELECT block_id, n.unique_id, {at}, {parent}, {name} AS name{listed} FROM {source} LEFT JOIN n USING (block_id)"


def _items_sql(kind: str, source: str, value: str, at: str, parent: str) -> str:
    kinds = "CASE json_type(item) WHEN 'VARCHAR' THEN 'text' ELSE 'number' END"
    return f"{_BLOCKS}{_ENTITY} SELECT block_id, n.unique_id, {at}, {parent}, item->>'$' AS value, {kinds} AS value_type FROM {_items(source, value)} LEFT JOIN n USING (block_id)"


def _at(a: str, b: str, c: str) -> str:
    return ", ".join(f"CAST({x} AS INTEGER) AS pos_{n}" for x, n in ((a, "a"), (b, "b"), (c, "c")))


def _under(kind: str, a: str, b: str) -> str:
    return f"'{kind}' AS parent_kind, CAST({a} AS INTEGER) AS parent_pos_a, CAST({b} AS INTEGER) AS parent_pos_b"


def _fields(*names: str) -> dict[str, str]:
    return {n: f"(e->'$.{n}')" for n in names}


_TABLES = {
    "p5_measure": _records_sql("measure", "m", "e->>'$.name'", _fields("type", "expression", "description", "field", "canonical"), _at("a", "-1", "-1"), _under("block", "-1", "-1")),
    "p5_metric": _records_sql("metric", "t", "e->>'$.name'", _fields("expression", "description", "template", "canonical") | {"time_field": "(CASE WHEN json_type(e, '$.grain') = 'OBJECT' THEN e->'$.grain.time_field' END)"}, _at("a", "-1", "-1"), _under("block", "-1", "-1")),
    "p5_filter": _records_sql("filter", "f", "e->>'$.field'", _fields("operator", "label"), _at("a", "c", "-1"), _under("metric", "a", "-1")),
    "p5_measure_synonym": _items_sql("measure_synonym", "m", "e->'$.synonyms'", _at("a", "place", "-1"), _under("measure", "a", "-1")),
    "p5_metric_synonym": _items_sql("metric_synonym", "t", "e->'$.synonyms'", _at("a", "place", "-1"), _under("metric", "a", "-1")),
    "p5_grain_key": _items_sql("grain_key", "g", "e->'$.grain.primary_key'", _at("a", "place", "-1"), _under("metric", "a", "-1")),
    "p5_grain_dimension": _items_sql("grain_dimension", "g", "e->'$.grain.dimensions'", _at("a", "place", "-1"), _under("metric", "a", "-1")),
    "p5_filter_value": _items_sql("filter_value", "f", "e->'$.values'", _at("a", "c", "place"), _under("filter", "a", "c")),
}

SQL = {
    **_TABLES,
    "p6_found": _WALK + "SELECT project_name, file_seq, field_path, change_kind FROM change",
    "p6_changes": _WALK + "SELECT * FROM change",
    "p6_schemas": _WALK + "SELECT project_name, file_seq, path AS field_path, t AS type FROM field",
    "p5_found": _BLOCKS + " SELECT block_id, child_kind, CAST(pos_a AS INTEGER) AS pos_a, CAST(pos_b AS INTEGER) AS pos_b, CAST(pos_c AS INTEGER) AS pos_c FROM r",
    "p1_found": _REFS + "SELECT ref_table, period, row_id, ref_id FROM o",
    "p1_report": _REFS + "SELECT ref_table, period, reason, count(*) AS orphan_references, count(DISTINCT ref_id) AS orphan_ids, count(DISTINCT row_id) AS orphan_rows FROM o GROUP BY 1, 2, 3",
    "p3_found": _TREE + "SELECT node AS unique_id, top AS root_id, CAST(dist AS INTEGER) AS depth FROM tree UNION ALL SELECT node, least, CAST(CASE WHEN on_loop THEN -1 ELSE -2 END AS INTEGER) FROM loop_end",
    "p3_paths": _TREE + """SELECT node AS unique_id, top AS root_id, CAST(dist AS INTEGER) AS depth, array_to_string(list_reverse(way), ' > ') AS path FROM tree
      UNION ALL SELECT node, least, CAST(CASE WHEN on_loop THEN -1 ELSE -2 END AS INTEGER), node FROM loop_end""",
    "p3_sizes": _TREE + "SELECT node.id AS unique_id, count(up.node) AS descendants FROM node LEFT JOIN up ON up.top = node.id AND up.dist > 0 AND NOT up.looped GROUP BY 1",
    "p3_descendants": _TREE + "SELECT top AS ancestor_id, node AS unique_id, CAST(dist AS INTEGER) AS distance FROM up WHERE dist > 0 AND NOT looped",
}
