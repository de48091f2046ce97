"""Duplicates, collisions, overlaps and findings about a project's models and indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.scores import pii_like, tokens
from metaloom.operators.inventory import layer
from metaloom.session import cut_lineage


def normal(col: str):
    return F.lower(F.trim(F.col(col)))


def duplicate_indicators(inventory: DataFrame) -> DataFrame:
    """(indicator_type, name, parents, canonical, expressions): indicators of one name and type that several parents define."""
    name = F.regexp_replace(normal("indicator_name"), "[ _-]+", "_")
    g = inventory.where("indicator_name is not null").groupBy("indicator_type", name.alias("name"))
    return g.agg(F.countDistinct("parent_unique_id").alias("parents"), F.count_if(F.coalesce("canonical", F.lit(False))).alias("canonical"), F.countDistinct("expression").alias("expressions")).where("parents > 1")


def near_duplicate_indicators(inventory: DataFrame) -> DataFrame:
    """(expression_key, indicators, first_id): indicators that say the same expression, white space, quotes and case aside, under different names.

    One row per expression with the number of names, so a common expression isn't paired with itself many times.
    """
    key = F.lower(F.regexp_replace("expression", r"[\s`\"']", ""))
    g = inventory.where("expression is not null").groupBy(key.alias("expression_key"))
    return g.agg(F.countDistinct(normal("indicator_name")).alias("indicators"), F.min("indicator_id").alias("first_id")).where("indicators > 1 and expression_key <> ''")


def label_collisions(inventory: DataFrame) -> DataFrame:
    """(label, indicators): labels (names and synonyms) that several indicators use."""
    labels = F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("indicator_name"))
    each = inventory.select("indicator_id", F.explode(labels).alias("l")).where("trim(l) <> ''").select("indicator_id", F.regexp_replace(normal("l"), "[ _-]+", " ").alias("label")).distinct()
    return each.groupBy("label").agg(F.count("*").alias("indicators")).where("indicators > 1")


def role_conflicts(columns: DataFrame) -> DataFrame:
    """(column_name, types, entities): columns of one name that entities declare with different types."""
    return columns.groupBy(F.lower("column_name").alias("column_name")).agg(F.countDistinct(F.lower("data_type")).alias("types"), F.countDistinct("unique_id").alias("entities")).where("types > 1")


def grain_signature(keys: str, time: str, dims: str):
    """A text that is equal for equal grains: sorted distinct keys, time field and dimensions."""
    def part(name, c):
        return F.concat(F.lit(name), F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))), ","))

    return F.concat_ws(";", part("pk=", keys), F.concat(F.lit("time="), F.coalesce(F.col(time), F.lit(""))), part("dims=", dims))


def metric_grains(records: DataFrame) -> DataFrame:
    """(block_id, unique_id, pos_a, name, grain) of each metric, from the child records of semantic blocks."""
    m = records.where("child_kind = 'metric'").select("block_id", "unique_id", "pos_a", F.col("value").alias("name"), "time_field")
    items = records.where("child_kind in ('grain_key', 'grain_dimension')").groupBy("block_id", "pos_a").agg(
        F.collect_set(F.when(F.col("child_kind") == "grain_key", F.col("value"))).alias("k"), F.collect_set(F.when(F.col("child_kind") == "grain_dimension", F.col("value"))).alias("d")
    )
    return m.join(items, ["block_id", "pos_a"], "left").select("block_id", "unique_id", "pos_a", "name", grain_signature("k", "time_field", "d").alias("grain"))


def multi_grain(grains: DataFrame) -> DataFrame:
    """(unique_id, grains): entities whose metrics have several grains."""
    return grains.groupBy("unique_id").agg(F.countDistinct("grain").alias("grains")).where("grains > 1")


def compare_grains(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which grains two entities (grain columns) share and which only one has."""
    x, y = a.select("grain").distinct(), b.select("grain").distinct()
    both = x.withColumn("l", F.lit(1)).join(y.withColumn("r", F.lit(1)), "grain", "full_outer")
    return both.select("grain", F.when(F.col("l").isNull(), "second").when(F.col("r").isNull(), "first").otherwise("both").alias("side"))


def overlap(entities: DataFrame, focus: DataFrame, name: str = "entity_name") -> DataFrame:
    """(focus_id, unique_id, shared, score): entities that share distinctive name words or tags with the entities of ``focus``.

    Surfaces are words of the name and tags; the score is 10 for each surface and 1 for each shared value.
    Values are met by equality with those of the focus set, never all entities by all.
    """
    def values(df: DataFrame, key: str) -> DataFrame:
        words = tokens(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "_", " "), 4)
        t = F.coalesce("tags", F.array().cast("array<string>"))
        w = df.select(F.col("unique_id").alias(key), F.lit("word").alias("surface"), F.explode(F.array_distinct(words)).alias("v"))
        return w.unionByName(df.select(F.col("unique_id").alias(key), F.lit("tag").alias("surface"), F.explode(F.array_distinct(t)).alias("v")).where("v is not null"))

    met = values(focus, "focus_id").join(values(entities, "unique_id"), ["surface", "v"]).where("focus_id <> unique_id")
    g = met.groupBy("focus_id", "unique_id").agg(F.countDistinct("surface").alias("surfaces"), F.count("*").alias("shared"))
    return g.select("focus_id", "unique_id", "shared", (F.col("surfaces") * 10 + F.col("shared")).alias("score"))


#: Each finding's category.
FINDINGS = {
    "duplicate_canonical_indicator": "indicator_resolution", "duplicate_indicator_without_canonical_parent": "indicator_resolution", "semantic_label_collision": "indicator_resolution", "entity_multiple_grain_variants": "grain_safety",
    "column_semantic_role_conflict": "column_semantics", "column_name_semantic_drift": "column_semantics", "indicator_parent_not_queryable": "queryability", "metric_missing_time_field": "grain_safety",
    "metric_output_column_missing": "queryability", "metric_grain_field_not_in_output": "grain_safety", "semantic_model_missing_primary_entity": "grain_safety", "semantic_model_missing_time_dimension": "grain_safety",
    "canonical_entity_missing_primary_key": "grain_safety", "multi_fact_metric_model": "cross_grain_risk", "ratio_like_metric_without_deterministic_surface": "cross_grain_risk", "cross_grain_kpi_without_semantic_artifact": "cross_grain_risk",
    "analyst_facing_model_depends_on_source": "layering", "agent_surface_too_many_parents": "layering", "non_mart_model_exposes_canonical_indicator": "layering", "helper_ranked_as_analyst_candidate": "layering",
    "analyst_surface_missing_governance": "governance", "pii_like_column_without_governance": "governance", "catalog_type_drift_on_indicator_field": "catalog_reality", "catalog_missing_indicator_field": "catalog_reality",
    "catalog_only_candidate_measure_column": "catalog_reality", "semantic_metric_unresolved_measure_ref": "semantic_artifact_integrity",
}
#: Relations are what these materializations make, and what these types are.
RELATIONS, RELATION_TYPES = ("table", "view", "incremental", "materialized_view"), ("source", "seed", "snapshot")
#: A surface with this many parents or more has too many.
TOO_MANY_PARENTS = 7


def normal_list(c):
    return F.transform(c, lambda x: F.lower(F.trim(x)))


def profiles(entities: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each entity with what the findings ask: its facts, parents, layer, and whether it is a relation, faces analysts, or holds facts.

    Each parent's type and grain is joined once; lists are of one entity's parents.
    """
    none = F.array().cast("array<string>")
    no = F.lit(False)
    relation = F.col("relation_name").isNotNull() | F.coalesce(F.col("materialization").isin(*RELATIONS), no) | F.coalesce(F.col("resource_type").isin(*RELATION_TYPES), no)
    exposes = (F.coalesce("measures", F.lit(0)) > 0) | (F.coalesce("metrics", F.lit(0)) > 0) | (F.size(F.coalesce("metric_names", none)) > 0)
    base = entities.drop("tags").join(facts.withColumnRenamed("role", "block_role"), "unique_id", "left")
    facing = ~F.coalesce(F.col("resource_type").isin("test", "macro"), no) & F.when(~F.coalesce("has_block", no), relation).otherwise(F.col("analyst") & (F.col("block_canonical") | exposes | relation))
    grains = F.array_distinct(F.concat(
        F.coalesce(F.transform(F.filter("metric_list", lambda m: m["grain"]), lambda m: grain_text(m["keys"], m["time_field"], m["dimensions"])), none),
        F.when(F.coalesce(F.size("grain_keys") > 0, no) | F.col("time_field").isNotNull(), F.array(grain_text(F.col("grain_keys"), F.col("time_field"), F.col("dimensions")))).otherwise(none),
    ))
    low = F.lower(F.trim(F.coalesce("entity_name", F.lit(""))))
    roles = F.coalesce(F.transform("columns", lambda c: F.lower(F.trim(c["role"]))), none)
    base = base.withColumn("relation", relation).withColumn("exposes", exposes).withColumn("facing", facing).withColumn("grains", grains).withColumn("layer", layer(F.col("entity_name")))
    base = base.withColumn("fact_like", low.startswith("fct_") | low.startswith("fact_") | exposes | F.coalesce(F.exists(roles, lambda r: r.isin("fact", "measure", "metric")), no))
    base = cut_lineage(base)
    up = edges.join(base.select(F.col("unique_id").alias("parent"), F.col("resource_type").alias("type"), "fact_like", F.col("grains").alias("g")), "parent", "left")
    parents = up.groupBy(F.col("child").alias("unique_id")).agg(
        F.count("*").alias("parents"), F.count_if(F.col("type") == "source").alias("source_parents"), F.count_if("fact_like").alias("fact_parents"), F.count_if(F.col("fact_like") & (F.size("g") > 0)).alias("fact_grained"),
        F.min(F.when(F.col("fact_like") & (F.size("g") > 0), F.array_join(F.array_sort("g"), "|"))).alias("least_grain"), F.max(F.when(F.col("fact_like") & (F.size("g") > 0), F.array_join(F.array_sort("g"), "|"))).alias("most_grain"),
    )
    return base.join(parents, "unique_id", "left")


def grain_text(keys, time, dims):
    """A text that is equal for equal grains: sorted distinct keys, time field and dimensions."""
    def part(c):
        return F.array_join(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), ",")

    return F.concat(F.lit("pk="), part(keys), F.lit(";time="), F.coalesce(time, F.lit("")), F.lit(";dims="), part(dims))


def findings(entities: DataFrame, facts: DataFrame, edges: DataFrame, semantic_metrics: DataFrame | None = None) -> DataFrame:
    """(code, severity, category, entity, package_name, indicator, evidence): everything questionable about indicators and their surfaces.

    Severities are blocker, high, medium and low. What concerns one entity comes from one scan of the
    :func:`profiles`; what concerns names that entities share, from counts by name. An
    entity without readable payload is judged by its row alone. Null and blank names have no findings.
    """
    p = cut_lineage(profiles(entities, facts, edges))
    no, none = F.lit(False), F.array().cast("array<string>")
    blank = F.lit(None).cast("string")

    def hit(when, code: str, severity, indicator=blank, evidence=blank):
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(F.coalesce(when, no), F.struct(F.lit(code).alias("code"), severity.alias("severity"), F.col("unique_id").alias("entity"), indicator.cast("string").alias("indicator"), evidence.cast("string").alias("evidence")))

    def emit(df: DataFrame, *hits) -> DataFrame:
        return df.select(F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.*")

    metadata_only = ~F.coalesce(F.col("resource_type").isin("metric", "semantic_model"), no) & ~F.col("relation")
    helper = F.coalesce(F.col("layer").isin("staging", "intermediate"), no)
    has_key = F.coalesce(F.size("grain_keys") > 0, no) | F.coalesce(F.exists("columns", lambda c: c["primary_key"]), no)
    several = F.coalesce(F.col("least_grain") != F.col("most_grain"), no)
    canonical_here = (F.col("block_canonical") & F.col("exposes")) | F.coalesce(F.size("canonical_names") > 0, no)
    model = (F.col("resource_type") == "semantic_model") & (F.coalesce("measures", F.lit(0)) > 0)
    one = emit(
        p,
        hit(F.size("grains") > 1, "entity_multiple_grain_variants", F.when(F.col("facing"), "high").otherwise("medium"), blank, F.size("grains")),
        hit(model & ~F.coalesce(F.size("grain_keys") > 0, no), "semantic_model_missing_primary_entity", "medium"), hit(model & F.col("time_field").isNull(), "semantic_model_missing_time_dimension", "high"),
        hit(F.col("block_canonical") & (F.col("resource_type") == "model") & ~has_key, "canonical_entity_missing_primary_key", "high"),
        hit(F.col("exposes") & (F.col("fact_parents") >= 2), "multi_fact_metric_model", F.when(several, "high").otherwise("medium"), blank, F.col("fact_parents")),
        hit(F.col("facing") & (F.col("source_parents") > 0), "analyst_facing_model_depends_on_source", "high", blank, F.col("source_parents")),
        hit(F.col("facing") & (F.col("parents") >= TOO_MANY_PARENTS), "agent_surface_too_many_parents", "medium", blank, F.col("parents")),
        hit(helper & canonical_here, "non_mart_model_exposes_canonical_indicator", "medium", blank, F.col("layer")),
        hit(helper & F.col("has_block") & F.col("analyst"), "helper_ranked_as_analyst_candidate", "low", blank, F.col("layer")),
        hit(F.col("facing") & ~F.coalesce("governed", no), "analyst_surface_missing_governance", "medium"),
    )

    names = normal_list(F.transform("columns", lambda c: c["column_name"]))
    m = p.where("size(metric_list) > 0").withColumn("m", F.explode("metric_list")).withColumn("names", F.coalesce(names, none))
    name, time = F.col("m.name"), F.when(F.col("m.grain"), F.col("m.time_field")).otherwise(F.col("time_field"))
    fields = F.when(F.col("m.grain"), F.concat("m.keys", F.array_compact(F.array("m.time_field")), "m.dimensions")).otherwise(F.concat(F.coalesce("grain_keys", none), F.array_compact(F.array("time_field")), F.coalesce("dimensions", none)))
    missing = F.array_except(normal_list(fields), F.col("names"))
    low = F.lower(name)
    ratio = F.contains(low, F.lit("_per_")) | low.endswith("_rate") | F.coalesce(F.contains(F.col("m.expression"), F.lit("/")), no)
    known = p.where("resource_type = 'metric'").select(normal("entity_name").alias("label")) if semantic_metrics is None else semantic_metrics.select(normal("name").alias("label"))
    m = m.withColumn("label", F.lower(F.trim("m.name"))).join(known.where("label is not null").distinct().withColumn("semantic", F.lit(True)), "label", "left")
    each_metric = emit(
        m,
        hit(metadata_only, "indicator_parent_not_queryable", "blocker", name), hit((F.coalesce("resource_type", F.lit("")) != "metric") & time.isNull(), "metric_missing_time_field", "high", name),
        hit(F.col("relation") & ~F.col("m.template") & ~F.array_contains("names", F.lower(F.trim(name))), "metric_output_column_missing", "medium", name),
        hit(F.col("relation") & (F.size(missing) > 0), "metric_grain_field_not_in_output", "high", name, F.array_join(F.array_sort(missing), ",")),
        hit(ratio & metadata_only, "ratio_like_metric_without_deterministic_surface", "blocker", name), hit(ratio & (F.col("fact_parents") >= 2) & F.col("semantic").isNull(), "cross_grain_kpi_without_semantic_artifact", "high", name),
    )
    ms = p.where("size(measure_list) > 0").withColumn("m", F.explode("measure_list"))
    bad = F.filter("columns", lambda c: c["column_name"] == F.col("m.field"))
    each_measure = emit(
        ms, hit(metadata_only, "indicator_parent_not_queryable", "blocker", F.col("m.name")), hit(F.exists(bad, lambda c: c["type_mismatch"]), "catalog_type_drift_on_indicator_field", "medium", F.col("m.name"), F.col("m.field")),
        hit(F.exists(bad, lambda c: c["missing_in_catalog"]), "catalog_missing_indicator_field", "high", F.col("m.name"), F.col("m.field")),
    )
    c = p.where("size(columns) > 0").withColumn("c", F.explode("columns"))
    numeric = F.lower(F.col("c.data_type")).rlike("int|num|dec|float|double|real")
    each_column = emit(
        c, hit(F.col("facing") & pii_like(F.col("c.column_name")) & ~F.coalesce("governed", no) & ~F.col("c.governance"), "pii_like_column_without_governance", "medium", blank, F.col("c.column_name")),
        hit(F.col("facing") & F.col("c.catalog_only") & numeric, "catalog_only_candidate_measure_column", "low", blank, F.col("c.column_name")),
    )
    semantic = p.where("resource_type = 'semantic_model'").select(F.explode(normal_list(F.coalesce("measure_names", none))).alias("ref")).distinct()
    refs = p.where("resource_type = 'metric'").select("unique_id", F.explode(normal_list(F.coalesce("measure_refs", none))).alias("ref"))
    unresolved = refs.join(semantic, "ref", "left_anti").groupBy("unique_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("r"))
    unresolved = emit(unresolved, hit(F.lit(True), "semantic_metric_unresolved_measure_ref", "high", blank, F.col("r")))

    # Names that entities share: a row for each definition, counted by name before they meet again.
    d = p.select("unique_id", "block_canonical", "grains", F.explode(F.concat(
        F.coalesce(F.transform("metric_list", lambda m: F.struct(F.lit("metric").alias("kind"), m["name"].alias("name"), m["canonical"].alias("canonical"), m["synonyms"].alias("synonyms"))), F.array().cast("array<struct<kind:string,name:string,canonical:boolean,synonyms:array<string>>>")),
        F.coalesce(F.transform("measure_list", lambda m: F.struct(F.lit("measure").alias("kind"), m["name"].alias("name"), m["canonical"].alias("canonical"), m["synonyms"].alias("synonyms"))), F.array().cast("array<struct<kind:string,name:string,canonical:boolean,synonyms:array<string>>>")),
    )).alias("d")).select("unique_id", "d.kind", F.lower(F.trim("d.name")).alias("name"), (F.col("d.canonical") | F.coalesce("block_canonical", no)).alias("canonical"), "d.synonyms", F.array_join(F.array_sort("grains"), "|").alias("g")).where("name <> ''")
    d = cut_lineage(d)
    dup = d.groupBy("kind", "name").agg(F.countDistinct("unique_id").alias("parents"), F.countDistinct(F.when(F.col("canonical"), F.col("unique_id"))).alias("canonical"), F.countDistinct("g").alias("variants"), F.min("unique_id").alias("unique_id"))
    shared = emit(
        dup, hit(F.col("canonical") > 1, "duplicate_canonical_indicator", F.when(F.col("variants") > 1, "blocker").otherwise("high"), F.col("name"), F.col("parents")),
        hit((F.col("parents") > 1) & (F.col("canonical") == 0), "duplicate_indicator_without_canonical_parent", "medium", F.col("name"), F.col("parents")),
    )
    labels = d.select("unique_id", "kind", "name", "canonical", F.explode(F.array_distinct(normal_list(F.array_append("synonyms", F.col("name"))))).alias("label")).where("label <> ''").distinct()
    met = labels.groupBy("label").agg(F.countDistinct("kind", "name").alias("indicators"), F.countDistinct(F.when(F.col("canonical"), F.struct("unique_id", "kind", "name"))).alias("canonical"), F.min("unique_id").alias("unique_id"))
    collisions = emit(met, hit(F.col("indicators") > 1, "semantic_label_collision", F.when(F.col("canonical") > 1, "high").otherwise("medium"), F.col("label"), F.col("indicators")))
    typed = p.select("unique_id", "facing", F.explode("columns").alias("c")).select("unique_id", "facing", F.lower(F.trim("c.column_name")).alias("name"), F.lower(F.trim("c.semantic_type")).alias("type"), F.lower(F.trim("c.role")).alias("role")).where("type <> ''")
    roles = typed.groupBy("type").agg(F.countDistinct(F.when(F.col("role") != "", F.col("role"))).alias("n"), F.min("unique_id").alias("unique_id"))
    types = typed.groupBy("name").agg(F.countDistinct("type").alias("n"), F.max("facing").alias("facing"), F.min("unique_id").alias("unique_id"))
    semantics = emit(roles, hit(F.col("n") > 1, "column_semantic_role_conflict", "medium", blank, F.col("type"))).unionByName(emit(types, hit((F.col("n") > 1) & F.col("facing"), "column_name_semantic_drift", "medium", blank, F.col("name"))))

    every = reduce(lambda a, b: a.unionByName(b), [one, each_metric, each_measure, each_column, unresolved, shared, collisions, semantics])
    category = F.element_at(F.create_map(*[F.lit(x) for kv in FINDINGS.items() for x in kv]), F.col("code"))
    pkg = entities.select(F.col("unique_id").alias("entity"), "package_name")
    return every.distinct().withColumn("category", category).join(pkg, "entity", "left").select("code", "severity", "category", "entity", "package_name", "indicator", "evidence")
