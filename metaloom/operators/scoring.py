"""Metadata scores of entities, packages and the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.scores import array_tier, clamped, description_tier, grade, percent

#: Each persona's weights of the categories, and the most points of each category.
WEIGHTS = {
    "default": {"documentation": 0.30, "semantic": 0.25, "governance": 0.25, "quality": 0.20},
    "analyst": {"documentation": 0.20, "semantic": 0.45, "governance": 0.15, "quality": 0.20},
    "engineer": {"documentation": 0.20, "semantic": 0.15, "governance": 0.15, "quality": 0.50},
    "governance": {"documentation": 0.15, "semantic": 0.15, "governance": 0.55, "quality": 0.15},
}
MAXIMA = {"documentation": 85, "semantic": 98, "governance": 100, "quality": 100}


def expects_columns(resource_type: Column) -> Column:
    return F.coalesce(resource_type.isin("model", "source", "seed", "snapshot"), F.lit(False))


def percent_points(pct: Column, most: int) -> Column:
    return clamped(pct / 100.0 * most, most)


def column_coverage(facts: DataFrame, tested: DataFrame) -> DataFrame:
    """(unique_id, …): each entity's columns counted for scores: described, semantic, critical and dimension columns with tests, keys, constraints.

    ``tested`` has unique_id, column_name and kind. A column without role is an identifier if it is a key.
    """
    has = tested.groupBy("unique_id", "column_name").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "unique").alias("u"), F.count_if(F.col("kind") == "not_null").alias("nn"))
    c = facts.select("unique_id", F.explode("columns").alias("c")).select("unique_id", "c.*").join(has, ["unique_id", "column_name"], "left")
    role = F.coalesce("role", F.when(F.col("primary_key"), "identifier"))
    weight = F.when(role.isin("identifier", "measure"), 3).when(role == "time", 2).otherwise(0)
    ok = F.col("n").isNotNull()
    tier = description_tier(F.col("description"), 100) / 100
    return c.groupBy("unique_id").agg(
        F.count("*").alias("n_columns"), F.avg(tier).alias("described"), F.count_if(F.col("role").isNotNull() | F.col("semantic_type").isNotNull()).alias("semantic_columns"),
        F.sum(weight).alias("critical"), F.sum(F.when(ok, weight).otherwise(0)).alias("critical_tested"), F.count_if(F.coalesce(role == "dimension", F.lit(False))).alias("dimension"),
        F.count_if(F.coalesce((role == "dimension") & ok, F.lit(False))).alias("dimension_tested"), F.sum("key_constraints").alias("key_constraints"), F.count_if("primary_key").alias("keys"),
        F.count_if(F.col("primary_key") & (F.coalesce("u", F.lit(0)) > 0) & (F.coalesce("nn", F.lit(0)) > 0)).alias("sound_keys"),
        F.collect_set(F.when((F.col("u") > 0) & (F.col("nn") > 0), F.col("column_name"))).alias("sound_columns"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) != "").alias("documented"),
    )


def entity_scores(entities: DataFrame, facts: DataFrame, tests: DataFrame, tested: DataFrame, persona: str = "default") -> DataFrame:
    """(unique_id, resource_type, package_name, documentation, semantic, governance, quality, overall, grade): scores of each entity.

    ``facts`` as by :func:`~metaloom.operators.payloads.payload_facts`, ``tests`` with unique_id and
    tests, ``tested`` with the tests of columns. Points: documentation of 85 (description 30,
    columns' descriptions 40, owner 15), semantic of 98 (synonyms, domains, use cases 12 each,
    column roles 30, grain 20, measures and metrics 12 each), governance of 100, quality
    of 100 (tests 30, key 20, the key's own tests 10, constraints 10). The overall score is
    their weighted sum in percent, rounded and at most 100.
    """
    none = F.lit(0)
    j = entities.join(facts.drop("columns", "role"), "unique_id", "left").join(column_coverage(facts, tested), "unique_id", "left").join(tests.select("unique_id", "tests"), "unique_id", "left")
    n, expected = F.coalesce("n_columns", none), expects_columns(F.col("resource_type"))
    owner = F.coalesce("owner", F.lit(False))
    described = F.when(n > 0, F.col("described")).otherwise(F.when(expected, 0.0).otherwise(1.0))
    doc = description_tier(F.coalesce("payload_description", "description"), 30) + clamped(described * 40, 40) + F.when(owner, 15).otherwise(0)

    def indicator(count: str, expression: str, synonyms: str, few: int) -> Column:
        base = F.when(~F.col(expression), few).when(~F.col(synonyms), 10).otherwise(15)
        return F.when((F.col("resource_type").eqNullSafe("source")) | (F.coalesce(count, none) == 0), 0).otherwise(clamped(base / 15 * 12, 12))

    role_pct = F.when(n > 0, percent(F.coalesce("semantic_columns", none), n, True)).otherwise(F.when(expected, 0).otherwise(100))
    semantic = (
        array_tier(F.coalesce("synonyms", none), 12) + array_tier(F.coalesce("domains", none), 12) + array_tier(F.coalesce("use_cases", none), 12) + percent_points(role_pct, 30)
        + F.when(F.coalesce("grain", F.lit(False)), 20).otherwise(0) + indicator("measures", "measure_expression", "measure_synonyms", 6) + indicator("metrics", "metric_expression", "metric_synonyms", 5)
    )
    governance = F.when(F.col("sensitivity").isNotNull(), 20).otherwise(0) + F.when(F.col("pii").isNotNull(), 30).otherwise(0) + array_tier(F.coalesce("compliance", none), 20) + F.when(owner, 30).otherwise(0)

    def covered(part: str, whole: str, most: int) -> Column:
        w = F.coalesce(whole, none)
        return percent_points(F.when(w > 0, clamped(F.coalesce(part, none) / F.nullif(w, none) * 100, 100)).otherwise(F.when(expected, 0).otherwise(100)), most)

    test_points = F.least(F.lit(30), F.when(F.coalesce("tests", none) > 0, 10).otherwise(0) + covered("critical_tested", "critical", 20) + covered("dimension_tested", "dimension", 10))
    no_keys = F.coalesce("keys", none) == 0
    grain_keys = F.coalesce("grain_keys", F.array().cast("array<string>"))
    has_key = ~no_keys | (F.size(grain_keys) > 0)
    sound = F.when(~no_keys, F.col("keys") == F.col("sound_keys")).otherwise((F.size(grain_keys) > 0) & (F.size(F.array_except(grain_keys, F.coalesce("sound_columns", F.array().cast("array<string>")))) == 0))
    quality = test_points + F.when(has_key, 20).otherwise(0) + F.when(sound, 10).otherwise(0) + array_tier(F.coalesce("key_constraints", none), 10)
    parts = {"documentation": doc, "semantic": semantic, "governance": governance, "quality": quality}
    s = j.select("unique_id", "resource_type", "package_name", *[v.cast("int").alias(k) for k, v in parts.items()])
    return overall(s, MAXIMA, persona)


def overall(scores: DataFrame, maxima: dict[str, int], persona: str) -> DataFrame:
    total = F.lit(0.0)
    for k, w in WEIGHTS[persona].items():
        total = total + F.col(k) / maxima[k] * 100 * w
    return scores.withColumn("overall", clamped(total, 100)).withColumn("grade", grade(F.col("overall")))


def column_scores(facts: DataFrame, tested: DataFrame, persona: str = "default") -> DataFrame:
    """(unique_id, column_name, documentation, semantic, governance, quality, overall, grade): scores of each declared column, of 100 each."""
    has = tested.select("unique_id", "column_name", F.lit(1).alias("t")).distinct()
    c = facts.select("unique_id", F.explode("columns").alias("c")).select("unique_id", "c.*").join(has, ["unique_id", "column_name"], "left")

    def if_(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    parts = {
        "documentation": description_tier(F.col("description"), 50) + if_(F.col("owner"), 50),
        "semantic": if_(F.col("role").isNotNull(), 30) + if_(F.col("semantic_type").isNotNull(), 30) + array_tier(F.size("synonyms"), 40),
        "governance": if_(F.col("sensitivity"), 40) + if_(F.col("pii"), 40) + array_tier(F.col("compliance"), 20),
        "quality": if_(F.col("data_type").isNotNull(), 40) + if_(F.col("t").isNotNull(), 40) + array_tier(F.col("constraints"), 20),
    }
    s = c.select("unique_id", "column_name", *[v.cast("int").alias(k) for k, v in parts.items()])
    return overall(s, dict.fromkeys(parts, 100), persona)


def coverage_gaps(facts: DataFrame, tested: DataFrame) -> DataFrame:
    """(unique_id, gap, severity, column_name, columns): keys without unique or not_null test are high, up to five untested columns low each, more are one medium gap."""
    has = tested.groupBy("unique_id", "column_name").agg(F.collect_set("kind").alias("kinds"))
    c = facts.select("unique_id", F.explode("columns").alias("c")).select("unique_id", "c.column_name", "c.primary_key").join(has, ["unique_id", "column_name"], "left")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    lacks = F.filter(F.array(F.lit("unique"), F.lit("not_null")), lambda k: ~F.array_contains(kinds, k))
    keys = c.where("primary_key").select("unique_id", F.explode(lacks).alias("k"), "column_name")
    high = keys.select("unique_id", F.concat(F.lit("missing_"), "k", F.lit("_test")).alias("gap"), F.lit("high").alias("severity"), "column_name", F.lit(1).cast("long").alias("columns"))
    bare = c.where("kinds is null")
    many = bare.groupBy("unique_id").agg(F.count("*").alias("columns"))
    low = bare.join(many.where("columns <= 5"), "unique_id").select("unique_id", F.lit("untested_column").alias("gap"), F.lit("low").alias("severity"), "column_name", F.lit(1).cast("long").alias("columns"))
    rest = many.where("columns > 5").select("unique_id", F.lit("many_untested_columns").alias("gap"), F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("column_name"), "columns")
    return high.unionByName(low).unionByName(rest)


def project_score(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean score, the count of each grade and the mean of each category, per group."""
    grades = [F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    return scores.groupBy(*by).agg(F.count("*").alias("entities"), F.round(F.avg("overall"), 4).alias("mean_overall"), *grades, *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in MAXIMA])


def worst(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy("overall", "unique_id").limit(k).select("unique_id", "overall", "grade")


def recommendations(scores: DataFrame) -> DataFrame:
    """(unique_id, category, gain, priority): what each category still lacks: 15 points or more are high, 8 or more medium."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), (F.lit(m) - F.col(c)).alias("gain")) for c, m in MAXIMA.items()])
    out = scores.select("unique_id", F.explode(each).alias("x")).where("x.gain > 0").select("unique_id", "x.category", "x.gain")
    return out.withColumn("priority", F.when(F.col("gain") >= 15, "high").when(F.col("gain") >= 8, "medium").otherwise("low"))


def provenance(entities: DataFrame, facts: DataFrame, tests: DataFrame, tested: DataFrame, as_of: str, stale_after_days: int = 30) -> DataFrame:
    """(unique_id, source_tier, doc_coverage_pct, freshness): where an entity stands, the share of its columns with descriptions, and how old its latest row is.

    The tier is ``semantic_layer`` with a canonical measure or metric, ``curated`` with an owner,
    description, block, documented column or test, else ``raw``.
    """
    j = entities.join(facts.drop("columns", "role"), "unique_id", "left").join(column_coverage(facts, tested), "unique_id", "left").join(tests.select("unique_id", "tests"), "unique_id", "left")
    no = F.lit(False)
    pct = F.round(F.coalesce(F.col("documented") / F.nullif(F.col("n_columns"), F.lit(0)) * 100, F.lit(0.0)), 2)
    some = F.coalesce("owner", no) | (F.trim(F.coalesce("payload_description", "description", F.lit(""))) != "") | F.coalesce("has_block", no) | (pct > 0) | (F.coalesce("tests", F.lit(0)) > 0)
    tier = F.when(F.coalesce("canonical_indicator", no), "semantic_layer").when(some, "curated").otherwise("raw")
    days = F.datediff(F.lit(as_of).cast("date"), F.col("created_at").cast("date"))
    fresh = F.when(days.isNull(), "unknown").when(days > stale_after_days, "stale").otherwise("fresh")
    return j.select("unique_id", tier.alias("source_tier"), pct.alias("doc_coverage_pct"), days.alias("age_days"), fresh.alias("freshness"))


def engineer_summary(entities: DataFrame, facts: DataFrame, tests: DataFrame, tested: DataFrame, children: DataFrame) -> DataFrame:
    """(unique_id, blast_radius, risk_points, risk, ready_points, readiness).

    Risk points: what depends on an entity (20 or more 3, 8 or more 2, 3 or more 1), no tests 2,
    less than half of the columns documented 1, no description 1; 5 are high, 3 medium.
    Readiness counts description, owner, tests, documented columns, grain, materialization
    and declared columns; 6 are high, 4 medium.
    """
    no, none = F.lit(False), F.lit(0)
    n = F.coalesce("n_children", none)
    j = entities.join(facts.drop("columns", "role"), "unique_id", "left").join(column_coverage(facts, tested), "unique_id", "left").join(tests.select("unique_id", "tests"), "unique_id", "left").join(children, "unique_id", "left")
    described = F.trim(F.coalesce("payload_description", "description", F.lit(""))) != ""
    half = F.coalesce(F.col("documented") / F.nullif(F.col("n_columns"), none) >= 0.5, no)
    points = F.when(n >= 20, 3).when(n >= 8, 2).when(n >= 3, 1).otherwise(0) + F.when(F.coalesce("tests", none) == 0, 2).otherwise(0) + F.when(half, 0).otherwise(1) + F.when(described, 0).otherwise(1)
    ready = sum((F.when(c, 1).otherwise(0) for c in (described, F.coalesce("owner", no), F.coalesce("tests", none) > 0, half, F.coalesce("grain", no), F.col("materialization").isNotNull(), F.coalesce("n_columns", none) > 0)), F.lit(0))
    level = F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low")
    return j.select("unique_id", n.alias("blast_radius"), points.alias("risk_points"), level.alias("risk"), ready.alias("ready_points"), F.when(ready >= 6, "high").when(ready >= 4, "medium").otherwise("low").alias("readiness"))


def analyst_summary(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(unique_id, confidence_points, confidence): a metric counts 2, a measure, a grain, a time field, a dimension and a second one 1 each; 5 are high, 3 medium."""
    j = entities.join(facts, "unique_id", "left")
    none, no = F.lit(0), F.lit(False)
    size = F.coalesce(F.size("dimensions"), none)
    terms = ((F.coalesce("metrics", none) > 0, 2), (F.coalesce("measures", none) > 0, 1), (F.coalesce("grain", no), 1), (F.col("time_field").isNotNull() | (F.coalesce("metric_time_fields", none) > 0), 1), (size > 0, 1), (size > 1, 1))
    points = sum((F.when(c, p).otherwise(0) for c, p in terms), F.lit(0))
    return j.select("unique_id", points.alias("confidence_points"), F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low").alias("confidence"))


def governance_gate(scores: DataFrame, entities: DataFrame, facts: DataFrame, tests: DataFrame, least_score: int = 60, policy: str = "fail") -> DataFrame:
    """(unique_id, reasons, gate): what an entity lacks for release, in fixed order; the gate is ``pass``, else the policy's ``fail`` or ``advisory``.

    Asked are a description, an owner, a least overall score, tests, and compliance labels where
    the block says that it holds personal data.
    """
    j = scores.select("unique_id", "overall").join(entities.select("unique_id", "description"), "unique_id").join(facts.drop("columns", "role"), "unique_id", "left").join(tests.select("unique_id", "tests"), "unique_id", "left")
    none, no = F.lit(0), F.lit(False)
    failed = {
        "missing_description": F.trim(F.coalesce("payload_description", "description", F.lit(""))) == "", "missing_owner": ~F.coalesce("owner", no), "score_below_minimum": F.col("overall") < least_score,
        "missing_tests": F.coalesce("tests", none) == 0, "missing_compliance_for_pii": (F.col("pii") == "true") & (F.coalesce("compliance", none) == 0),
    }
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in failed.items()]))
    return j.select("unique_id", F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) == 0, "pass").otherwise(policy).alias("gate"))


def readiness(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """(package_name, entities, mean_overall, errors, band): a package is blocked by a blocker, else high from 85, medium from 70, low below."""
    bad = findings.where("severity = 'blocker'").groupBy("package_name").agg(F.count("*").alias("errors"))
    p = scores.groupBy("package_name").agg(F.count("*").alias("entities"), F.round(F.avg("overall"), 4).alias("mean_overall")).join(bad, "package_name", "left")
    e = F.coalesce("errors", F.lit(0))
    return p.select("package_name", "entities", "mean_overall", e.alias("errors"), F.when(e > 0, "blocked").when(F.col("mean_overall") >= 85, "high").when(F.col("mean_overall") >= 70, "medium").otherwise("low").alias("band"))


def audit(scores: DataFrame, changed: DataFrame, required: int = 60, advisory: int = 75) -> DataFrame:
    """(unique_id, overall, status) of the entities that changed: fail below the required score, advisory below the advised one."""
    hit = scores.join(changed.select("unique_id").distinct(), "unique_id", "left_semi")
    return hit.select("unique_id", "overall", F.when(F.col("overall") < required, "fail").when(F.col("overall") < advisory, "advisory").otherwise("pass").alias("status"))
