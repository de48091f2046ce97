"""Filters, counts, pages and lookups over entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.scores import glob_prefix, glob_regex
from metaloom.functions.text import norm_id

PAGE, MOST_PAGE, MOST_OFFSET, MOST_IDS = 50, 2000, 10_000, 5000


def current(entities: DataFrame) -> DataFrame:
    """One row per id: the one created last. Rows without id are none; id is trimmed and in lower case."""
    rest = [c for c in entities.columns if c not in ("unique_id", "created_at")]
    last = entities.select(norm_id("unique_id").alias("unique_id"), F.struct("created_at", *rest).alias("x")).where("unique_id is not null")
    return last.groupBy("unique_id").agg(F.max("x").alias("x")).select("unique_id", "x.*")


def count_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("resource_type").agg(F.count("*").alias("entities"))


def count_by_tag(entities: DataFrame) -> DataFrame:
    """Entities that bear each tag; a tag repeated on one entity counts once."""
    return entities.select("unique_id", F.explode(F.array_distinct("tags")).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("entities"))


def count_by_package(entities: DataFrame) -> DataFrame:
    """Entities of each package; those without are of the package ``''``."""
    return entities.groupBy(F.coalesce("package_name", F.lit("")).alias("package_name")).agg(F.count("*").alias("entities"))


def count_by_database(entities: DataFrame) -> DataFrame:
    """Entities by ``database.schema``; by the one that is there if the other is missing; those with neither don't count."""
    d, s = F.coalesce("database_name", F.lit("")), F.coalesce("schema_name", F.lit(""))
    key = F.concat_ws(".", F.when(d != "", d), F.when(s != "", s))
    return entities.select(key.alias("location")).where("location <> ''").groupBy("location").agg(F.count("*").alias("entities"))


def matching(entities: DataFrame, resource_type: str | None = None, package: str | None = None, tags: list[str] | None = None, location: str | None = None) -> DataFrame:
    """Entities of a type (in any case), a package, with all of ``tags``, and of a ``database.schema``: exactly that, or one that holds it if none is exactly that."""
    out = entities
    if resource_type is not None:
        out = out.where(F.lower("resource_type") == resource_type.lower())
    if package is not None:
        out = out.where(F.col("package_name") == package)
    for t in tags or []:
        out = out.where(F.array_contains("tags", t))
    if location is not None:
        key = F.concat_ws(".", "database_name", "schema_name")
        exact = entities.where(key == location).limit(1).count()
        out = out.where(key == location if exact else F.contains(F.lower(key), F.lit(location.lower())))
    return out


def page(df: DataFrame, order: list[Column | str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a listing in a total order."""
    return df.orderBy(*order).offset(min(max(0, offset), MOST_OFFSET)).limit(max(1, min(limit or PAGE, MOST_PAGE)))


def lookup(entities: DataFrame, id_or_name: str) -> DataFrame:
    """The entity of this id, else all of this exact name: more than one is ambiguous."""
    by_id = entities.where(F.col("unique_id") == id_or_name.strip().lower())
    return by_id if by_id.limit(1).count() else entities.where(F.col("entity_name") == id_or_name)


def batch_lookup(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """(unique_id, found, entity_name, resource_type) of each distinct id asked for."""
    asked = ids.select(norm_id("unique_id").alias("unique_id")).where("unique_id is not null").distinct()
    return asked.join(entities.select("unique_id", "entity_name", "resource_type", F.lit(True).alias("hit")), "unique_id", "left").select(
        "unique_id", F.coalesce("hit", F.lit(False)).alias("found"), "entity_name", "resource_type"
    )


def find_by_path(entities: DataFrame, path: Column, pattern: str) -> DataFrame:
    """(path, unique_id) of entities whose path fits the pattern; its fixed start is a prefix filter, which prunes the scan."""
    here = entities.select(path.alias("path"), "unique_id")
    return here.where(F.col("path").startswith(glob_prefix(pattern)) & F.col("path").rlike(glob_regex(pattern)))


#: How names begin, and folders of paths, by layer; the first that fits.
LAYERS = {"staging": (("stg_", "stage_"), ("staging", "stage")), "intermediate": (("int_", "intermediate_"), ("intermediate", "int")), "mart": (("mart_",), ("marts", "mart"))}


def layer(name: Column, path: Column | None = None, rules: dict = LAYERS) -> Column:
    """A model's layer by the start of its name or a folder of its path, in lower case; null if no rule fits."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    where = F.lower(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r"\\\\", "/")) if path is not None else F.lit("")
    out = F.lit(None).cast("string")
    for known, (starts, folders) in reversed(rules.items()):
        fits = low.rlike("^(" + "|".join(starts) + ")") | where.rlike("/(" + "|".join(folders) + ")/")
        out = F.when(fits, known).otherwise(out)
    return out


def test_type(name: Column) -> Column:
    """The generic test that a test's name begins with; ``custom`` for others."""
    found = F.regexp_extract(name, "^(not_null|unique|accepted_values|relationships)_", 1)
    return F.when(found == "", "custom").otherwise(found)


def attached_tests(tests_by_entity: DataFrame) -> DataFrame:
    """(unique_id, test_id): each test of each entity once."""
    named = F.filter(F.transform("test_ids", norm_id), lambda t: t.isNotNull())
    return tests_by_entity.select(norm_id("unique_id").alias("unique_id"), F.explode(named).alias("test_id")).where("unique_id is not null").distinct()


def test_coverage(entities: DataFrame, tests: DataFrame) -> DataFrame:
    """(unique_id, tests, generic_tests, custom_tests, types): the tests of each entity that can be tested."""
    kind = test_type(F.element_at(F.split("test_id", r"\."), 3))
    each = tests.withColumn("kind", kind)
    by = each.groupBy("unique_id").agg(F.count("*").alias("tests"), F.count_if(F.col("kind") != "custom").alias("generic_tests"), F.array_sort(F.collect_set("kind")).alias("types"))
    models = entities.where(F.col("resource_type").isin("model", "seed", "snapshot", "source")).select("unique_id", "package_name", "resource_type")
    n = F.coalesce("tests", F.lit(0))
    return models.join(by, "unique_id", "left").select(
        "unique_id", "package_name", "resource_type", n.alias("tests"), F.coalesce("generic_tests", F.lit(0)).alias("generic_tests"),
        (n - F.coalesce("generic_tests", F.lit(0))).alias("custom_tests"), F.array_join(F.coalesce("types", F.array().cast("array<string>")), ",").alias("types"),
    )


def coverage_by_package(coverage: DataFrame) -> DataFrame:
    share = F.round(100 * F.count_if(F.col("tests") > 0) / F.count("*"), 2)
    return coverage.groupBy("package_name").agg(F.count("*").alias("entities"), F.count_if(F.col("tests") > 0).alias("tested"), share.alias("coverage_pct"))


def undocumented(entities: DataFrame) -> DataFrame:
    """Entities whose description is null or blank."""
    return entities.where(F.trim(F.coalesce("description", F.lit(""))) == "").select("unique_id", "resource_type", "package_name")


def set_diff(a: DataFrame, b: DataFrame, column: str) -> tuple[Column, Column, Column]:
    """Columns only in the first, only in the second, and in both, as sorted lists, of list columns ``a.column`` and ``b.column``."""
    x, y = F.coalesce(a[column], F.array().cast("array<string>")), F.coalesce(b[column], F.array().cast("array<string>"))
    return F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x)), F.array_sort(F.array_intersect(x, y))


def manifest_health(entities: DataFrame) -> DataFrame:
    """One row of counts of what is missing from the entities."""
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    return entities.agg(
        F.count("*").alias("entities"), F.count_if(blank).alias("undocumented"), F.count_if(F.col("materialization").isNull() & (F.col("resource_type") == "model")).alias("models_without_materialization"),
        F.count_if(F.size(F.coalesce("tags", F.array())) == 0).alias("untagged"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
    )


def text_flags(texts: DataFrame) -> DataFrame:
    """(doc_id, templated, malformed_ref): templating marks, and a ref call that is not closed."""
    return texts.where("text is not null").select("doc_id", F.col("text").rlike(r"\{\{|\{%|\{#").alias("templated"), F.col("text").rlike(r"ref\((?![^()\n]*\))").alias("malformed_ref"))
