"""Queries of scoring, modelling, evaluation and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import context, evals, inventory, modelling, nested, payloads, scoring, search, validation
from metaloom.queries import metadata, problems, retrieval
from metaloom.session import cut_lineage, table
from metaloom.sources import manifest
from metaloom.streaming import traces as streams


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(payloads.payload_facts(table(spark, sf_dir, "nova_blocks")))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.column_tests(metadata._entities(spark, sf_dir), inventory.attached_tests(table(spark, sf_dir, "tests_by_entity")))


def _scores(spark: SparkSession, sf_dir: str, persona: str = "default") -> DataFrame:
    return scoring.entity_scores(metadata._entities(spark, sf_dir), _facts(spark, sf_dir), metadata._coverage(spark, sf_dir), _tested(spark, sf_dir), persona)


def score_columns(spark, sf_dir):
    return scoring.column_scores(_facts(spark, sf_dir), _tested(spark, sf_dir))


def column_tests(spark, sf_dir):
    return _tested(spark, sf_dir)


def coverage_gaps(spark, sf_dir):
    return scoring.coverage_gaps(_facts(spark, sf_dir), _tested(spark, sf_dir))


def score_entities(spark, sf_dir):
    return _scores(spark, sf_dir).select("unique_id", "documentation", "semantic", "governance", "quality", "overall", "grade")


def score_governance(spark, sf_dir):
    return _scores(spark, sf_dir, "governance").select("unique_id", "overall", "grade")


def score_packages(spark, sf_dir):
    return scoring.project_score(_scores(spark, sf_dir), ["package_name"])


def score_project(spark, sf_dir):
    return scoring.project_score(_scores(spark, sf_dir), ["resource_type"])


def score_worst(spark, sf_dir):
    return scoring.worst(_scores(spark, sf_dir))


def recommendations(spark, sf_dir):
    return scoring.recommendations(_scores(spark, sf_dir)).groupBy("category", "priority").agg(F.count("*").alias("entities"), F.sum("gain").alias("gain"))


def provenance(spark, sf_dir):
    return scoring.provenance(metadata._entities(spark, sf_dir), _facts(spark, sf_dir), metadata._coverage(spark, sf_dir), _tested(spark, sf_dir), "2026-06-30")


def engineer_summary(spark, sf_dir):
    children = metadata._edges(spark, sf_dir).groupBy(F.col("parent").alias("unique_id")).agg(F.count("*").alias("n_children"))
    return scoring.engineer_summary(metadata._entities(spark, sf_dir), _facts(spark, sf_dir), metadata._coverage(spark, sf_dir), _tested(spark, sf_dir), children)


def analyst_summary(spark, sf_dir):
    return scoring.analyst_summary(metadata._entities(spark, sf_dir), _facts(spark, sf_dir))


def governance_gate(spark, sf_dir):
    return scoring.governance_gate(_scores(spark, sf_dir, "governance"), metadata._entities(spark, sf_dir), _facts(spark, sf_dir), metadata._coverage(spark, sf_dir), 30)


def audit_changed(spark, sf_dir):
    changed = metadata._entities(spark, sf_dir).where("created_at >= timestamp_ntz'2024-02-01'").select("unique_id")
    return scoring.audit(_scores(spark, sf_dir), changed, 20, 40)


def _records(spark, sf_dir):
    return cut_lineage(nested.child_records(table(spark, sf_dir, "nova_blocks")))


def _findings(spark, sf_dir):
    return modelling.findings(metadata._entities(spark, sf_dir), _facts(spark, sf_dir), metadata._edges(spark, sf_dir))


def findings(spark, sf_dir):
    return _findings(spark, sf_dir)


def readiness(spark, sf_dir):
    return scoring.readiness(_scores(spark, sf_dir), _findings(spark, sf_dir))


def validate_blocks(spark, sf_dir):
    return validation.validate_blocks(table(spark, sf_dir, "nova_blocks"))


def multi_grain(spark, sf_dir):
    return modelling.multi_grain(modelling.metric_grains(_records(spark, sf_dir)))


def compare_grains(spark, sf_dir):
    g = cut_lineage(modelling.metric_grains(_records(spark, sf_dir)))
    return modelling.compare_grains(g.where("block_id % 2 = 0"), g.where("block_id % 2 = 1"))


def entity_overlap(spark, sf_dir):
    e = metadata._entities(spark, sf_dir)
    focus = e.where(F.col("unique_id") == metadata.HUB)
    return modelling.overlap(e, focus).select("unique_id", "shared", "score")


def _pairs(spark, sf_dir):
    """Each entity with its first parent in id order."""
    return metadata._edges(spark, sf_dir).groupBy(F.col("child").alias("first_id")).agg(F.min("parent").alias("second_id"))


def diff_entities(spark, sf_dir):
    tests = inventory.attached_tests(table(spark, sf_dir, "tests_by_entity"))
    held = cut_lineage(context.sections(metadata._entities(spark, sf_dir), _facts(spark, sf_dir), tests))
    return context.diff_entities(_pairs(spark, sf_dir), held)


def entity_context(spark, sf_dir):
    tests = inventory.attached_tests(table(spark, sf_dir, "tests_by_entity"))
    return context.contexts(metadata._entities(spark, sf_dir), _facts(spark, sf_dir), metadata._edges(spark, sf_dir), tests, table(spark, sf_dir, "documents")).drop("description")


def docs_for_entity(spark, sf_dir):
    return context.documents_of(table(spark, sf_dir, "documents"), metadata._entities(spark, sf_dir))


def get_columns(spark, sf_dir):
    """Declared columns of each entity's latest payload, keys marked."""
    return payloads.columns_of(_facts(spark, sf_dir)).select("unique_id", "column_name", "data_type", "primary_key")


def entity_detail(spark, sf_dir):
    return context.detail(metadata._entities(spark, sf_dir), "standard", context.LEVELS).drop("tags")


def _inventory(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "indicator_inventory"))


def role_conflicts(spark, sf_dir):
    return modelling.role_conflicts(metadata._payload_columns(spark, sf_dir))


def catalog_drift(spark, sf_dir):
    """Columns that payloads declare against a catalog made of the same columns a type and a few names apart."""
    c = cut_lineage(metadata._payload_columns(spark, sf_dir))
    catalog = c.where("column_name not like 's%'").select("unique_id", "column_name", F.when(F.col("data_type") == "int", "bigint").otherwise(F.col("data_type")).alias("catalog_type"))
    extra = c.where("column_name like 'c%'").select("unique_id", F.concat("column_name", F.lit("_x")).alias("column_name"), F.col("data_type").alias("catalog_type"))
    return manifest.catalog_drift(c.dropDuplicates(["unique_id", "column_name", "data_type"]), catalog.unionByName(extra))


def ir_metrics(spark, sf_dir):
    ranked = search.top(retrieval.bm25_bulk(spark, sf_dir).select("qid", F.col("unique_id").alias("id"), "score"), 10)
    return evals.ir_summary(evals.ir_metrics(ranked, evals.relevant(table(spark, sf_dir, "search_eval_qrels"))))


def _results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").alias("at"), F.col("user_id").alias("case_id"), F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("status"))


def eval_history(spark, sf_dir):
    return evals.run_pass_rates(_results(spark, sf_dir)).select("run_id", "cases", "pass_rate")


def eval_gate(spark, sf_dir):
    return evals.gate(_results(spark, sf_dir), 0.7)


def eval_compare(spark, sf_dir):
    r = _results(spark, sf_dir)
    a, b = [x[0] for x in evals.run_pass_rates(r).orderBy("run_id").select("run_id").limit(2).collect()]
    return evals.compare_runs(r, a, b)


def eval_retained(spark, sf_dir):
    return evals.retain_newest(_results(spark, sf_dir), 3).groupBy("run_id").agg(F.count("*").alias("rows"))


TOOLS = {"click": "search", "view": "get_entity", "purchase": "execute_sql", "signup": "search_indicator", "error": "get_lineage"}


def _traces(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("at"), F.element_at(names, F.col("event_type")).alias("tool"), F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("call_index"), F.col("value").alias("duration"),
        (F.col("event_type") != "error").alias("success"), F.length("props").cast("long").alias("bytes"), (F.col("value") > 90).alias("truncated"),
    )


def _of_traces(f):
    return lambda spark, sf_dir: f(_traces(spark, sf_dir))


def asof_join(spark, sf_dir):
    """Each purchase with the user's last click before it, by one sorted stream of both."""
    from pyspark.sql.window import Window as W

    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    both = e.where("event_type in ('purchase', 'click')").select("event_id", "user_id", "event_type", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w).alias("click_id"))
    return both.where("event_type = 'purchase'").select("event_id", "click_id")


QUERIES = {
    **{f.__name__: f for f in (
        score_entities, score_governance, score_packages, score_project, score_worst, recommendations, provenance, engineer_summary, analyst_summary, governance_gate, score_columns, column_tests, coverage_gaps, audit_changed, findings, readiness, validate_blocks, multi_grain, compare_grains,
        entity_overlap, diff_entities, entity_context, docs_for_entity, entity_detail, get_columns, role_conflicts, catalog_drift, ir_metrics, eval_history, eval_gate, eval_compare, eval_retained, asof_join,
    )},
    "duplicate_indicators": _inventory(modelling.duplicate_indicators), "near_duplicate_indicators": _inventory(modelling.near_duplicate_indicators), "label_collisions": _inventory(modelling.label_collisions),
    "trace_summary": _of_traces(evals.trace_summary), "trace_semantic_first": _of_traces(evals.semantic_first), "latency": _of_traces(lambda t: evals.latency(t, "duration")),
    "trace_windows": _of_traces(lambda t: streams.tool_windows(t).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tool", "calls", "errors", F.round("mean_duration", 6).alias("mean_duration"))),
    "trace_sessions": _of_traces(lambda t: streams.sessions(t).select("session", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")),
    "trace_redacted": lambda s, d: table(s, d, "events").select("event_id", evals.redact(F.concat(F.lit("https://user:pw@host/x?token="), F.col("event_type"), F.lit("&k=1"))).alias("line")),
}

_FACTS = metadata.T.rstrip() + r""", nb AS (SELECT lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) AS id, payload_json AS p, row_number() OVER (PARTITION BY lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) ORDER BY captured_at DESC NULLS LAST, block_id DESC) AS r
  FROM nova_blocks WHERE payload_json IS NOT NULL AND regexp_matches(unique_id, '\S')),
j AS (SELECT * FROM (SELECT id, CAST(p AS JSON) AS p FROM nb WHERE r = 1 AND json_valid(p)) WHERE json_type(p) = 'OBJECT'),
k AS (SELECT id, p, p->>'$.description' AS pd, coalesce(trim(coalesce(p->>'$.meta.owner', p->>'$.config.meta.owner', p->>'$.owner')) <> '', FALSE) AS owner,
  CASE WHEN json_type(p, '$.meta.nova') = 'OBJECT' THEN p->'$.meta.nova' WHEN json_type(p, '$.config.meta.nova') = 'OBJECT' THEN p->'$.config.meta.nova' END AS b FROM j),
me AS (SELECT id, count(*) AS n, coalesce(bool_or(json_type(e) = 'OBJECT' AND list_contains(json_keys(e), 'expression')), FALSE) AS ex, coalesce(bool_or(json_type(e, '$.synonyms') = 'ARRAY' AND json_array_length(e, '$.synonyms') > 0), FALSE) AS sy, coalesce(bool_or(e->>'$.canonical' = 'true'), FALSE) AS ca
  FROM (SELECT id, unnest(from_json(b->'$.measures', '["JSON"]')) AS e FROM k WHERE json_type(b, '$.measures') = 'ARRAY') GROUP BY 1),
mh AS (SELECT id, b, CASE WHEN coalesce(json_type(b, '$.metrics'), 'NULL') <> 'NULL' THEN b->'$.metrics' ELSE b->'$.metric' END AS h FROM k),
ml AS (SELECT id, unnest(CASE WHEN json_type(h) = 'ARRAY' THEN from_json(h, '["JSON"]') WHEN json_type(h) = 'OBJECT' THEN [h] ELSE [] END) AS e FROM mh),
mt AS (SELECT id, count(*) AS n, coalesce(bool_or(json_type(e) = 'OBJECT' AND list_contains(json_keys(e), 'expression')), FALSE) AS ex, coalesce(bool_or(json_type(e, '$.synonyms') = 'ARRAY' AND json_array_length(e, '$.synonyms') > 0), FALSE) AS sy FROM ml GROUP BY 1),
every AS (SELECT id, e FROM ml WHERE json_type(e) = 'OBJECT' UNION ALL SELECT id, b->'$.metric' FROM mh WHERE json_type(b, '$.metric') = 'OBJECT' AND coalesce(json_type(b, '$.metrics'), 'NULL') <> 'NULL'),
ev AS (SELECT id, bool_or(coalesce(json_type(e, '$.grain') = 'OBJECT' AND len(json_keys(e, '$.grain')) > 0, FALSE)) AS g, bool_or(coalesce(json_type(e, '$.canonical') = 'BOOLEAN' AND e->>'$.canonical' = 'true', FALSE)) AS ca, count(*) FILTER (WHERE json_type(e, '$.grain') = 'OBJECT' AND json_type(e, '$.grain.time_field') = 'VARCHAR') AS tf FROM every GROUP BY 1),
f AS (SELECT id, owner, pd, b IS NOT NULL AS has_block, b->>'$.governance.sensitivity' AS sensitivity, b->>'$.governance.pii' AS pii, coalesce(me.n, 0) AS measures, me.ex AS mex, me.sy AS msy, coalesce(mt.n, 0) AS metrics, mt.ex AS tex, mt.sy AS tsy,
  coalesce(json_type(b, '$.grain') = 'OBJECT' AND len(json_keys(b, '$.grain')) > 0, FALSE) OR coalesce(ev.g, FALSE) AS grain, coalesce(me.ca, FALSE) OR coalesce(ev.ca, FALSE) OR (b->>'$.canonical' = 'true' AND (me.n > 0 OR ev.id IS NOT NULL)) AS canonical,
  CASE WHEN json_type(b, '$.grain') = 'OBJECT' THEN list_filter([x->>'$' for x in CASE WHEN json_type(b, '$.grain.primary_key') = 'ARRAY' THEN from_json(b->'$.grain.primary_key', '["JSON"]') WHEN json_type(b, '$.grain.primary_key') = 'VARCHAR' THEN [b->'$.grain.primary_key'] ELSE [] END if json_type(x) = 'VARCHAR'], lambda y: trim(y) <> '') ELSE [] END AS gk,
  CASE WHEN json_type(b, '$.grain') = 'OBJECT' THEN list_filter([x->>'$' for x in CASE WHEN json_type(b, '$.grain.dimensions') = 'ARRAY' THEN from_json(b->'$.grain.dimensions', '["JSON"]') WHEN json_type(b, '$.grain.dimensions') = 'VARCHAR' THEN [b->'$.grain.dimensions'] ELSE [] END if json_type(x) = 'VARCHAR'], lambda y: trim(y) <> '') ELSE [] END AS dims,
  CASE WHEN json_type(b, '$.grain') = 'OBJECT' THEN b->>'$.grain.time_field' END AS time_field, coalesce(ev.tf, 0) AS metric_time_fields,
  CASE WHEN json_type(b, '$.synonyms') = 'ARRAY' THEN json_array_length(b, '$.synonyms') ELSE 0 END AS syn, CASE WHEN json_type(b, '$.domains') = 'ARRAY' THEN json_array_length(b, '$.domains') ELSE 0 END AS dom, CASE WHEN json_type(b, '$.use_cases') = 'ARRAY' THEN json_array_length(b, '$.use_cases') ELSE 0 END AS uses,
  CASE WHEN json_type(b, '$.governance.compliance') = 'ARRAY' THEN json_array_length(b, '$.governance.compliance') ELSE 0 END AS comp FROM k LEFT JOIN me USING (id) LEFT JOIN mt USING (id) LEFT JOIN ev USING (id)),
c0 AS (SELECT id, name, json_extract(p, '$.columns."' || name || '"') AS c FROM (SELECT id, p, unnest(json_keys(p, '$.columns')) AS name FROM j WHERE json_type(p, '$.columns') = 'OBJECT')),
c1 AS (SELECT id, name, c, CASE WHEN coalesce(json_type(c, '$.meta.nova'), 'NULL') <> 'NULL' THEN c->'$.meta.nova' ELSE c->'$.config.meta.nova' END AS b, coalesce(c->>'$.meta.primary_key', c->>'$.config.meta.primary_key', '') IN ('true', 'yes', '1') AS pk,
  coalesce(trim(coalesce(c->>'$.meta.owner', c->>'$.config.meta.owner', c->>'$.owner')) <> '', FALSE) AS owner FROM c0 WHERE json_type(c) = 'OBJECT'),
ct AS (SELECT DISTINCT tt.unique_id AS id, substr(string_split(test_id, '.')[3], strlen(kind) + strlen(entity_name) + 3) AS name, kind FROM tt JOIN e ON e.unique_id = tt.unique_id WHERE kind <> 'custom' AND starts_with(substr(string_split(test_id, '.')[3], strlen(kind) + 2), lower(entity_name) || '_')),
cn AS (SELECT id, name, count(*) FILTER (WHERE kind = 'unique') AS u, count(*) FILTER (WHERE kind = 'not_null') AS nn FROM ct GROUP BY 1, 2),
c2 AS (SELECT c1.*, cn.id IS NOT NULL AS tested, coalesce(u, 0) > 0 AND coalesce(nn, 0) > 0 AS sound, coalesce(c1.b->>'$.role', CASE WHEN pk THEN 'identifier' END) AS role, c1.b->>'$.semantic_type' AS st,
  CASE WHEN json_type(c, '$.description') = 'VARCHAR' THEN strlen(trim(c->>'$.description')) ELSE 0 END AS dl, CASE WHEN json_type(c, '$.constraints') = 'ARRAY' THEN json_array_length(c, '$.constraints') ELSE 0 END AS cons FROM c1 LEFT JOIN cn ON cn.id = c1.id AND cn.name = c1.name),
cc AS (SELECT id, count(*) AS n, avg(CASE WHEN dl = 0 THEN 0::DOUBLE WHEN dl < 20 THEN 0.2::DOUBLE WHEN dl < 50 THEN 0.5::DOUBLE WHEN dl < 100 THEN 0.8::DOUBLE ELSE 1::DOUBLE END) AS described, count(*) FILTER (WHERE b->>'$.role' IS NOT NULL OR st IS NOT NULL) AS sem,
  sum(CASE WHEN role IN ('identifier', 'measure') THEN 3 WHEN role = 'time' THEN 2 ELSE 0 END) AS crit, sum(CASE WHEN NOT tested THEN 0 WHEN role IN ('identifier', 'measure') THEN 3 WHEN role = 'time' THEN 2 ELSE 0 END) AS critt, count(*) FILTER (WHERE role = 'dimension') AS dim, count(*) FILTER (WHERE role = 'dimension' AND tested) AS dimt,
  count(*) FILTER (WHERE pk) AS keys, count(*) FILTER (WHERE pk AND sound) AS sound_keys, list(name) FILTER (WHERE sound) AS sound_names, count(*) FILTER (WHERE dl > 0) AS documented FROM c2 GROUP BY 1)
"""


_EDGES = r""", pm AS (SELECT unique_id AS c, unnest(parent_ids) AS p FROM parent_map WHERE regexp_matches(unique_id, '\S')),
  edge AS (SELECT DISTINCT lower(regexp_replace(c, '^\s+|\s+$', '', 'g')) AS child, lower(regexp_replace(p, '^\s+|\s+$', '', 'g')) AS parent FROM pm WHERE regexp_matches(p, '\S'))"""


def _tier(n: str, most: int) -> str:
    return f"CAST(round(CASE WHEN coalesce({n}, 0) <= 0 THEN 0::DOUBLE WHEN {n} = 1 THEN 0.4::DOUBLE WHEN {n} = 2 THEN 0.7::DOUBLE ELSE 1::DOUBLE END * {most}) AS INTEGER)"


def _clamp(x: str, most: int) -> str:
    return f"CAST(round(least(greatest({x}, 0::DOUBLE), {most}::DOUBLE)) AS INTEGER)"


def _words(n: str, most: int) -> str:
    return f"CAST(round(CASE WHEN {n} = 0 THEN 0::DOUBLE WHEN {n} < 20 THEN 0.2::DOUBLE WHEN {n} < 50 THEN 0.5::DOUBLE WHEN {n} < 100 THEN 0.8::DOUBLE ELSE 1::DOUBLE END * {most}) AS INTEGER)"


def _total(maxima: dict[str, int], persona: str) -> str:
    w = scoring.WEIGHTS[persona]
    return _clamp(" + ".join(f"{c}::DOUBLE / {m} * 100 * {w[c]}::DOUBLE" for c, m in maxima.items()), 100)


_GRADE = "CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade"
_EXPECTED = "coalesce(e.resource_type IN ('model', 'source', 'seed', 'snapshot'), FALSE)"


def _share(part: str, whole: str, most: int) -> str:
    pct = f"CASE WHEN coalesce({whole}, 0) > 0 THEN {_clamp(f'coalesce({part}, 0)::DOUBLE / {whole} * 100', 100)} WHEN {_EXPECTED} THEN 0 ELSE 100 END"
    return _clamp(f"({pct}) / 100.0::DOUBLE * {most}", most)


def _indicator(n: str, expression: str, synonyms: str, few: int) -> str:
    points = f"CASE WHEN NOT {expression} THEN {few} WHEN NOT {synonyms} THEN 10 ELSE 15 END"
    return f"CASE WHEN coalesce(e.resource_type, '') = 'source' OR coalesce({n}, 0) = 0 THEN 0 ELSE {_clamp(f'({points}) / 15::DOUBLE * 12', 12)} END"


def _score_sql(persona: str) -> str:
    own, text = "coalesce(owner, FALSE)", "strlen(trim(coalesce(pd, description, '')))"
    return _FACTS + f""", p AS (SELECT e.unique_id, e.resource_type, e.package_name,
      {_words(text, 30)} + {_clamp(f"CASE WHEN cc.n > 0 THEN described WHEN {_EXPECTED} THEN 0::DOUBLE ELSE 1::DOUBLE END * 40", 40)} + CASE WHEN {own} THEN 15 ELSE 0 END AS documentation,
      {_tier('syn', 12)} + {_tier('dom', 12)} + {_tier('uses', 12)} + {_share('sem', 'cc.n', 30)} + CASE WHEN coalesce(grain, FALSE) THEN 20 ELSE 0 END + {_indicator('measures', 'mex', 'msy', 6)} + {_indicator('metrics', 'tex', 'tsy', 5)} AS semantic,
      CASE WHEN sensitivity IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN pii IS NOT NULL THEN 30 ELSE 0 END + {_tier('comp', 20)} + CASE WHEN {own} THEN 30 ELSE 0 END AS governance,
      CAST(least(30, CASE WHEN coalesce(cov.tests, 0) > 0 THEN 10 ELSE 0 END + {_share('critt', 'crit', 20)} + {_share('dimt', 'dim', 10)}) + CASE WHEN coalesce(keys, 0) > 0 OR len(coalesce(gk, [])) > 0 THEN 20 ELSE 0 END
        + CASE WHEN coalesce(keys, 0) > 0 THEN CASE WHEN keys = sound_keys THEN 10 ELSE 0 END WHEN len(coalesce(gk, [])) > 0 AND len([y for y in gk if NOT list_contains(coalesce(sound_names, []), y)]) = 0 THEN 10 ELSE 0 END AS INTEGER) AS quality
      FROM e LEFT JOIN f ON f.id = e.unique_id LEFT JOIN cc ON cc.id = e.unique_id LEFT JOIN cov ON cov.unique_id = e.unique_id),
    s AS (SELECT *, {_total(scoring.MAXIMA, persona)} AS overall FROM p), sc AS (SELECT *, {_GRADE} FROM s)
    """


def _rollup_sql(by: str) -> str:
    grades = ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF")
    means = ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in scoring.MAXIMA)
    return _score_sql("default") + f"SELECT {by}, count(*) AS entities, round(avg(overall), 4) AS mean_overall, {grades}, {means} FROM sc GROUP BY 1"


_DUP = "WITH d AS (SELECT indicator_type, regexp_replace(lower(trim(indicator_name)), '[ _-]+', '_', 'g') AS name, count(DISTINCT parent_unique_id) AS parents, count(*) FILTER (WHERE canonical) AS canonical, count(DISTINCT expression) AS expressions FROM indicator_inventory WHERE indicator_name IS NOT NULL GROUP BY 1, 2)"
_RES = "WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, ts AS happened, user_id AS case_id, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS status FROM events), g AS (SELECT run_id, max(happened) AS happened, count(*) AS cases, round(avg(CASE WHEN status = 'pass' THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM r GROUP BY 1)"
_TR = "WITH t AS (SELECT ts AS happened, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TOOLS.items()) + " END AS tool, CAST(user_id AS VARCHAR) AS session, event_id AS call_index, value AS duration, event_type <> 'error' AS success, length(props) AS bytes, value > 90 AS truncated FROM events)"

_GRAINS = problems._BLOCKS + f""", kk AS (SELECT block_id, a, list(DISTINCT item->>'$' ORDER BY item->>'$') AS l FROM {problems._items("g", "e->'$.grain.primary_key'")} GROUP BY 1, 2), kd AS (SELECT block_id, a, list(DISTINCT item->>'$' ORDER BY item->>'$') AS l FROM {problems._items("g", "e->'$.grain.dimensions'")} GROUP BY 1, 2),
      un AS (SELECT block_id, min(unique_id) AS unique_id FROM nova_blocks GROUP BY 1),
      sg AS (SELECT block_id, unique_id, 'pk=' || coalesce(array_to_string(kk.l, ','), '') || ';time=' || coalesce(CASE WHEN json_type(e, '$.grain') = 'OBJECT' THEN e->>'$.grain.time_field' END, '') || ';dims=' || coalesce(array_to_string(kd.l, ','), '') AS s FROM t JOIN un USING (block_id) LEFT JOIN kk USING (block_id, a) LEFT JOIN kd USING (block_id, a))
"""

SQL = {
    "score_entities": _score_sql("default") + "SELECT unique_id, documentation, semantic, governance, quality, overall, grade FROM sc",
    "score_governance": _score_sql("governance") + "SELECT unique_id, overall, grade FROM sc",
    "score_packages": _rollup_sql("package_name"), "score_project": _rollup_sql("resource_type"),
    "score_worst": _score_sql("default") + "SELECT unique_id, overall, grade FROM sc ORDER BY overall, unique_id LIMIT 10",
    "recommendations": _score_sql("default") + ", r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, {m} - {c} AS gain FROM sc" for c, m in scoring.MAXIMA.items()) + ") SELECT category, CASE WHEN gain >= 15 THEN 'high' WHEN gain >= 8 THEN 'medium' ELSE 'low' END AS priority, count(*) AS entities, CAST(sum(gain) AS BIGINT) AS gain FROM r WHERE gain > 0 GROUP BY 1, 2",
    "provenance": _FACTS + """, x AS (SELECT e.unique_id, coalesce(round(documented::DOUBLE / nullif(cc.n, 0) * 100, 2), 0::DOUBLE) AS pct, f.*, description, cov.tests, created_at FROM e LEFT JOIN f ON f.id = e.unique_id LEFT JOIN cc ON cc.id = e.unique_id LEFT JOIN cov ON cov.unique_id = e.unique_id)
      SELECT unique_id, CASE WHEN coalesce(canonical, FALSE) THEN 'semantic_layer' WHEN coalesce(owner, FALSE) OR trim(coalesce(pd, description, '')) <> '' OR coalesce(has_block, FALSE) OR pct > 0 OR coalesce(tests, 0) > 0 THEN 'curated' ELSE 'raw' END AS source_tier, pct AS doc_coverage_pct,
      CAST(date_diff('day', created_at::DATE, DATE '2026-06-30') AS INTEGER) AS age_days, CASE WHEN created_at IS NULL THEN 'unknown' WHEN date_diff('day', created_at::DATE, DATE '2026-06-30') > 30 THEN 'stale' ELSE 'fresh' END AS freshness FROM x""",
    "engineer_summary": _FACTS + r""", pm AS (SELECT unique_id AS c, unnest(parent_ids) AS p FROM parent_map WHERE regexp_matches(unique_id, '\S')),
      edge AS (SELECT DISTINCT lower(regexp_replace(c, '^\s+|\s+$', '', 'g')) AS child, lower(regexp_replace(p, '^\s+|\s+$', '', 'g')) AS parent FROM pm WHERE regexp_matches(p, '\S')), ch AS (SELECT parent, count(*) AS n FROM edge GROUP BY 1),
      y AS (SELECT e.unique_id, coalesce(ch.n, 0) AS blast_radius, coalesce(documented::DOUBLE / nullif(cc.n, 0) >= 0.5, FALSE) AS half, trim(coalesce(pd, description, '')) <> '' AS said, coalesce(tests, 0) > 0 AS tst, coalesce(owner, FALSE) AS own, coalesce(grain, FALSE) AS gr, materialization IS NOT NULL AS mat, coalesce(cc.n, 0) > 0 AS cols
        FROM e LEFT JOIN f ON f.id = e.unique_id LEFT JOIN cc ON cc.id = e.unique_id LEFT JOIN cov ON cov.unique_id = e.unique_id LEFT JOIN ch ON ch.parent = e.unique_id),
      x AS (SELECT unique_id, blast_radius, CAST(CASE WHEN blast_radius >= 20 THEN 3 WHEN blast_radius >= 8 THEN 2 WHEN blast_radius >= 3 THEN 1 ELSE 0 END + CASE WHEN tst THEN 0 ELSE 2 END + CASE WHEN half THEN 0 ELSE 1 END + CASE WHEN said THEN 0 ELSE 1 END AS INTEGER) AS risk_points,
        CAST(said::INT + own::INT + tst::INT + half::INT + gr::INT + mat::INT + cols::INT AS INTEGER) AS ready_points FROM y)
      SELECT *, CASE WHEN risk_points >= 5 THEN 'high' WHEN risk_points >= 3 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN ready_points >= 6 THEN 'high' WHEN ready_points >= 4 THEN 'medium' ELSE 'low' END AS readiness FROM x""",
    "analyst_summary": _FACTS + """, x AS (SELECT e.unique_id, CAST(CASE WHEN coalesce(metrics, 0) > 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(measures, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(grain, FALSE) THEN 1 ELSE 0 END + CASE WHEN time_field IS NOT NULL OR coalesce(metric_time_fields, 0) > 0 THEN 1 ELSE 0 END
      + CASE WHEN len(coalesce(dims, [])) > 0 THEN 1 ELSE 0 END + CASE WHEN len(coalesce(dims, [])) > 1 THEN 1 ELSE 0 END AS INTEGER) AS confidence_points FROM e LEFT JOIN f ON f.id = e.unique_id) SELECT *, CASE WHEN confidence_points >= 5 THEN 'high' WHEN confidence_points >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM x""",
    "governance_gate": _score_sql("governance") + """, x AS (SELECT sc.unique_id, array_to_string(list_filter([CASE WHEN trim(coalesce(pd, description, '')) = '' THEN 'missing_description' END, CASE WHEN NOT coalesce(owner, FALSE) THEN 'missing_owner' END, CASE WHEN overall < 30 THEN 'score_below_minimum' END,
      CASE WHEN coalesce(cov.tests, 0) = 0 THEN 'missing_tests' END, CASE WHEN pii = 'true' AND coalesce(comp, 0) = 0 THEN 'missing_compliance_for_pii' END], lambda y: y IS NOT NULL), ',') AS reasons FROM sc JOIN e ON e.unique_id = sc.unique_id LEFT JOIN f ON f.id = sc.unique_id LEFT JOIN cov ON cov.unique_id = sc.unique_id)
      SELECT unique_id, reasons, CASE WHEN reasons = '' THEN 'pass' ELSE 'fail' END AS gate FROM x""",
    "column_tests": _FACTS + "SELECT id AS unique_id, name AS column_name, kind FROM ct",
    "coverage_gaps": _FACTS + """, cu AS (SELECT c1.id, c1.name, pk, coalesce(u, 0) > 0 AS u, coalesce(nn, 0) > 0 AS nn, cn.id IS NULL AS bare FROM c1 LEFT JOIN cn ON cn.id = c1.id AND cn.name = c1.name), m AS (SELECT id, count(*) AS n FROM cu WHERE bare GROUP BY 1)
      SELECT id AS unique_id, 'missing_unique_test' AS gap, 'high' AS severity, name AS column_name, 1 AS columns FROM cu WHERE pk AND NOT u UNION ALL SELECT id, 'missing_not_null_test', 'high', name, 1 FROM cu WHERE pk AND NOT nn
      UNION ALL SELECT id, 'untested_column', 'low', name, 1 FROM cu JOIN m USING (id) WHERE bare AND n <= 5 UNION ALL SELECT id, 'many_untested_columns', 'medium', NULL, n FROM m WHERE n > 5""",
    "score_columns": _FACTS + f""", x AS (SELECT id AS unique_id, name AS column_name, {_words('dl', 50)} + CASE WHEN owner THEN 50 ELSE 0 END AS documentation,
      CASE WHEN b->>'$.role' IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN st IS NOT NULL THEN 30 ELSE 0 END + {_tier("CASE WHEN json_type(b, '$.synonyms') = 'ARRAY' THEN len([y for y in from_json(b->'$.synonyms', '[" + chr(34) + "JSON" + chr(34) + "]') if json_type(y) = 'VARCHAR' AND trim(y->>'$') <> '']) WHEN json_type(b, '$.synonyms') = 'VARCHAR' THEN 1 ELSE 0 END", 40)} AS semantic,
      CASE WHEN json_type(b, '$.governance.sensitivity') = 'VARCHAR' THEN 40 ELSE 0 END + CASE WHEN b->>'$.governance.pii' IS NOT NULL THEN 40 ELSE 0 END + {_tier("CASE WHEN json_type(b, '$.governance.compliance') = 'ARRAY' THEN json_array_length(b, '$.governance.compliance') ELSE 0 END", 20)} AS governance,
      CASE WHEN c->>'$.data_type' IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN tested THEN 40 ELSE 0 END + {_tier('cons', 20)} AS quality FROM c2), s AS (SELECT *, {_total(dict.fromkeys(scoring.MAXIMA, 100), "default")} AS overall FROM x) SELECT *, {_GRADE} FROM s""",
    "audit_changed": _score_sql("default") + "SELECT sc.unique_id, overall, CASE WHEN overall < 20 THEN 'fail' WHEN overall < 40 THEN 'advisory' ELSE 'pass' END AS status FROM sc JOIN e ON e.unique_id = sc.unique_id WHERE e.created_at >= TIMESTAMP '2024-02-01'",
    "duplicate_indicators": _DUP + " SELECT * FROM d WHERE parents > 1",
    "near_duplicate_indicators": r"SELECT * FROM (SELECT lower(regexp_replace(expression, '[\s`" + "\"''" + r"]', '', 'g')) AS expression_key, count(DISTINCT lower(trim(indicator_name))) AS indicators, min(indicator_id) AS first_id FROM indicator_inventory WHERE expression IS NOT NULL GROUP BY 1) WHERE indicators > 1 AND expression_key <> ''",
    "label_collisions": "SELECT label, count(*) AS indicators FROM (SELECT DISTINCT indicator_id, regexp_replace(lower(trim(l)), '[ _-]+', ' ', 'g') AS label FROM (SELECT indicator_id, unnest(list_append(coalesce(synonyms, []), indicator_name)) AS l FROM indicator_inventory) WHERE trim(l) <> '') GROUP BY 1 HAVING count(*) > 1",
    "role_conflicts": "WITH x AS (SELECT 1)" + metadata.PAYLOAD_COLUMNS + " SELECT lower(column_name) AS column_name, count(DISTINCT lower(data_type)) AS types, count(DISTINCT unique_id) AS entities FROM pc GROUP BY 1 HAVING count(DISTINCT lower(data_type)) > 1",
    "catalog_drift": "WITH x AS (SELECT 1)" + metadata.PAYLOAD_COLUMNS + """, c AS (SELECT unique_id, lower(column_name) AS n, CASE WHEN data_type = 'int' THEN 'bigint' ELSE data_type END AS ct FROM pc WHERE column_name NOT LIKE 's%' UNION ALL SELECT unique_id, lower(column_name || '_x'), data_type FROM pc WHERE column_name LIKE 'c%')
      SELECT coalesce(pc.unique_id, c.unique_id) AS unique_id, coalesce(lower(pc.column_name), c.n) AS column_name, coalesce(c.ct, pc.data_type) AS data_type, CASE WHEN c.n IS NULL THEN 'missing_in_catalog' WHEN pc.column_name IS NULL THEN 'catalog_only' WHEN lower(pc.data_type) <> lower(c.ct) THEN 'type_mismatch' END AS drift
      FROM pc FULL OUTER JOIN c ON pc.unique_id = c.unique_id AND lower(pc.column_name) = c.n""",
    "entity_overlap": metadata.E + f""", v AS (SELECT DISTINCT unique_id, 'word' AS surface, w AS v FROM (SELECT unique_id, unnest(string_split(lower(coalesce(entity_name, '')), '_')) AS w FROM e) WHERE strlen(w) >= 4 UNION ALL SELECT DISTINCT unique_id, 'tag', t FROM (SELECT unique_id, unnest(tags) AS t FROM e) WHERE t IS NOT NULL)
      SELECT b.unique_id, count(*) AS shared, count(DISTINCT surface) * 10 + count(*) AS score FROM v a JOIN v b USING (surface, v) WHERE a.unique_id = '{metadata.HUB}' AND b.unique_id <> a.unique_id GROUP BY 1""",
    "ir_metrics": retrieval.SQL["bm25_bulk"].split(" SELECT qid, id AS unique_id")[0] + r""", rel AS (SELECT qid, id, max(grade) AS grade FROM (SELECT entry_id AS qid, lower(regexp_replace(u.unique_id, '^\s+|\s+$', '', 'g')) AS id, u.grade AS grade
        FROM (SELECT entry_id, unnest(relevant) AS u FROM (SELECT DISTINCT ON (entry_id) entry_id, relevant FROM search_eval_qrels)) WHERE regexp_matches(u.unique_id, '\S')) WHERE grade > 0 GROUP BY 1, 2),
      rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 3) DESC, id) AS rank FROM ranked WHERE rank <= 10),
      il AS (SELECT qid, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM rel) WHERE r <= 10 GROUP BY 1),
      mt AS (SELECT rel.qid, count(*) AS n, count(rank) AS found, min(rank) AS first, coalesce(sum(CASE WHEN rank IS NOT NULL THEN (pow(2, grade) - 1) / log2(rank + 1) END), 0) AS dcg FROM rel LEFT JOIN rk ON rk.qid = rel.qid AND rk.id = rel.id GROUP BY 1),
      pq AS (SELECT round(found::DOUBLE / n, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(dcg / idcg, 6) AS ndcg, found > 0 AS hit FROM mt JOIN il USING (qid))
      SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM pq""",
    "docs_for_entity": metadata.E + r"SELECT DISTINCT e.unique_id, doc_id FROM documents d JOIN e ON e.unique_id = lower(regexp_replace(d.unique_id, '^\s+|\s+$', '', 'g')) WHERE doc_id IS NOT NULL",
    "entity_detail": metadata.E + "SELECT unique_id, entity_name, resource_type, package_name, description, database_name, schema_name, materialization FROM e",
    "diff_entities": _FACTS + _EDGES + """, pr AS (SELECT child AS first_id, min(parent) AS second_id FROM edge GROUP BY 1),
      vs AS (SELECT id AS u, 'columns' AS section, name AS v FROM c1 UNION SELECT unique_id, 'tags', unnest(tags) FROM e UNION SELECT id, 'grain', unnest(list_concat(list_concat([('key=' || y) for y in gk], CASE WHEN time_field IS NULL THEN [] ELSE ['time=' || time_field] END), [('dimension=' || y) for y in dims])) FROM f
        UNION SELECT id, 'indicators', 'measure:' || (e->>'$.name') FROM (SELECT id, unnest(from_json(b->'$.measures', '["JSON"]')) AS e FROM k WHERE json_type(b, '$.measures') = 'ARRAY') WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.name') = 'VARCHAR'
        UNION SELECT id, 'indicators', 'metric:' || (e->>'$.name') FROM every WHERE json_type(e, '$.name') = 'VARCHAR' UNION SELECT id, 'governance', 'sensitivity=' || sensitivity FROM f WHERE sensitivity IS NOT NULL UNION SELECT id, 'governance', 'pii=' || (@pii) FROM k WHERE (@pii) IS NOT NULL
        UNION SELECT unique_id, 'tests', test_id FROM tt),
      ls AS (SELECT u, section, list(DISTINCT v ORDER BY v) AS l FROM vs WHERE v IS NOT NULL GROUP BY 1, 2), sn AS (SELECT unnest(['columns', 'tags', 'grain', 'indicators', 'governance', 'tests']) AS section),
      dd AS (SELECT first_id, second_id, section, coalesce(a.l, []) AS x, coalesce(b.l, []) AS y FROM pr JOIN e p ON p.unique_id = first_id JOIN e q ON q.unique_id = second_id CROSS JOIN sn LEFT JOIN ls a ON a.u = first_id AND a.section = sn.section LEFT JOIN ls b ON b.u = second_id AND b.section = sn.section)
      SELECT first_id, second_id, section, array_to_string([t for t in x if NOT list_contains(y, t)], ',') AS only_first, array_to_string([t for t in y if NOT list_contains(x, t)], ',') AS only_second, array_to_string([t for t in x if list_contains(y, t)], ',') AS both FROM dd""".replace("SELECT first_id, second_id, section, coalesce(a.l", "SELECT first_id, second_id, sn.section, coalesce(a.l").replace("@pii", problems._shown("(b->'$.governance.pii')")),
    "entity_context": _FACTS + _EDGES + r""", dc AS (SELECT DISTINCT lower(regexp_replace(unique_id, '^\s+|\s+$', '', 'g')) AS u, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS v FROM documents WHERE regexp_matches(unique_id, '\S')),
      up AS (SELECT child AS u, count(*) AS n, array_to_string(list_sort(list(parent))[:5], ',') AS l FROM edge GROUP BY 1), dn AS (SELECT parent AS u, count(*) AS n, array_to_string(list_sort(list(child))[:5], ',') AS l FROM edge GROUP BY 1),
      ts AS (SELECT unique_id AS u, count(*) AS n, array_to_string(list_sort(list(test_id))[:5], ',') AS l FROM tt GROUP BY 1), ds AS (SELECT u, count(*) AS n, array_to_string(list_sort(list(v))[:5], ',') AS l FROM dc GROUP BY 1), nc AS (SELECT id, count(*) AS n FROM c1 GROUP BY 1)
      SELECT e.unique_id, resource_type, entity_name, package_name, coalesce(nc.n, 0) AS n_columns, coalesce(measures, 0) AS measures, coalesce(metrics, 0) AS metrics, coalesce(owner, FALSE) AS owner, coalesce(up.n, 0) AS n_upstream, coalesce(up.l, '') AS upstream, coalesce(dn.n, 0) AS n_downstream, coalesce(dn.l, '') AS downstream,
        coalesce(ts.n, 0) AS n_tests, coalesce(ts.l, '') AS tests, coalesce(ds.n, 0) AS n_documents, coalesce(ds.l, '') AS documents
      FROM e LEFT JOIN f ON f.id = e.unique_id LEFT JOIN nc ON nc.id = e.unique_id LEFT JOIN up ON up.u = e.unique_id LEFT JOIN dn ON dn.u = e.unique_id LEFT JOIN ts ON ts.u = e.unique_id LEFT JOIN ds ON ds.u = e.unique_id""",
    "get_columns": _FACTS + "SELECT id AS unique_id, name AS column_name, c->>'$.data_type' AS data_type, pk AS primary_key FROM c1",
    "multi_grain": _GRAINS + "SELECT unique_id, count(DISTINCT s) AS grains FROM sg GROUP BY 1 HAVING count(DISTINCT s) > 1",
    "compare_grains": _GRAINS + "SELECT s AS grain, CASE WHEN bool_and(block_id % 2 = 0) THEN 'first' WHEN bool_and(block_id % 2 <> 0) THEN 'second' ELSE 'both' END AS side FROM sg GROUP BY 1",
    "eval_history": _RES + " SELECT run_id, cases, pass_rate FROM g",
    "eval_gate": _RES + ", h AS (SELECT run_id, pass_rate, lag(pass_rate) OVER (ORDER BY happened, run_id) AS previous_rate, row_number() OVER (ORDER BY happened DESC, run_id DESC) AS r FROM g) SELECT run_id, pass_rate, previous_rate, CASE WHEN pass_rate < 0.7 OR previous_rate - pass_rate > 0.02 THEN 'fail' ELSE 'pass' END AS status FROM h WHERE r = 1",
    "eval_compare": _RES + """, o AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS n FROM g), a AS (SELECT case_id, min(status) AS s FROM r JOIN o USING (run_id) WHERE n = 1 GROUP BY 1), b AS (SELECT case_id, min(status) AS s FROM r JOIN o USING (run_id) WHERE n = 2 GROUP BY 1)
      SELECT coalesce(a.case_id, b.case_id) AS case_id, a.s AS first_status, b.s AS second_status, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> 'pass' AND b.s = 'pass' THEN 'fixed' WHEN a.s = 'pass' AND b.s <> 'pass' THEN 'broken' ELSE 'same' END AS change FROM a FULL OUTER JOIN b ON a.case_id = b.case_id""",
    "eval_retained": _RES + " SELECT run_id, count(*) AS rows FROM r WHERE run_id IN (SELECT run_id FROM g ORDER BY happened DESC, run_id DESC LIMIT 3) GROUP BY 1",
    "trace_summary": _TR + " SELECT tool, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS errors, count(*) FILTER (WHERE truncated) AS truncated, CAST(sum(bytes) AS BIGINT) AS bytes, min(call_index) AS first_index FROM t GROUP BY 1",
    "trace_semantic_first": _TR + ", m AS (SELECT session, min(call_index) FILTER (WHERE tool = 'search_indicator') AS s, min(call_index) FILTER (WHERE tool = 'execute_sql') AS q FROM t GROUP BY 1) SELECT session, CASE WHEN s IS NULL AND q IS NULL THEN 'not_applicable' WHEN q IS NULL THEN 'observed_without_sql' WHEN s IS NULL THEN 'not_observed' WHEN s < q THEN 'pass' ELSE 'warn' END AS verdict FROM m",
    "latency": _TR + " SELECT tool, count(*) AS calls, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95, " + ", ".join(f"count(*) FILTER (WHERE duration <= {e}) AS le_{e}" for e in (1, 5, 10, 50, 100, 500)) + " FROM t GROUP BY 1",
    "trace_windows": _TR + " SELECT strftime(time_bucket(INTERVAL '1 hour', happened), '%Y-%m-%d %H:%M:%S') AS start, tool, count(*) AS calls, count(*) FILTER (WHERE NOT success) AS errors, round(avg(duration), 6) AS mean_duration FROM t GROUP BY 1, 2",
    "trace_sessions": _TR + """, a AS (SELECT *, CASE WHEN happened < lag(happened) OVER (PARTITION BY session ORDER BY happened, call_index) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM t), b AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY happened, call_index) AS s FROM a)
      SELECT session, strftime(min(happened), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls FROM b GROUP BY session, s""",
    "trace_redacted": "SELECT event_id, 'https://***@host/x?token=***&k=1' AS line FROM events",
    "asof_join": "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
}
