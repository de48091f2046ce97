"""What a reader of an entity wants at once: its context, and how it differs from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.functions.text import norm_id

SECTIONS = ("columns", "tags", "grain", "indicators", "governance", "tests")
NONE = "array<string>"


def nothing() -> Column:
    return F.array().cast(NONE)


def sections(entities: DataFrame, facts: DataFrame, tests: DataFrame) -> DataFrame:
    """(unique_id, section, values): each entity's columns, tags, grain, indicators, governance and tests as sorted lists of texts."""
    attached = tests.groupBy("unique_id").agg(F.array_sort(F.collect_set("test_id")).alias("tests"))
    j = entities.select("unique_id", "tags").join(facts.drop("role"), "unique_id", "left").join(attached, "unique_id", "left")

    def said(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(label + "="), value))

    grain = F.concat(F.transform(F.coalesce("grain_keys", nothing()), lambda k: F.concat(F.lit("key="), k)), F.array_compact(F.array(said("time", F.col("time_field")))), F.transform(F.coalesce("dimensions", nothing()), lambda d: F.concat(F.lit("dimension="), d)))
    lists = {
        "columns": F.transform("columns", lambda c: c["column_name"]), "tags": F.array_compact(F.col("tags")), "grain": grain,
        "indicators": F.concat(F.transform(F.coalesce("measure_names", nothing()), lambda m: F.concat(F.lit("measure:"), m)), F.transform(F.coalesce("metric_names", nothing()), lambda m: F.concat(F.lit("metric:"), m))),
        "governance": F.array_compact(F.array(said("sensitivity", F.col("sensitivity")), said("pii", F.col("pii")))), "tests": F.col("tests"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("section"), F.array_sort(F.array_distinct(F.coalesce(v, nothing()))).alias("values")) for k, v in lists.items()])
    return j.select("unique_id", F.explode(each).alias("x")).select("unique_id", "x.section", "x.values")


def diff_entities(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(first_id, second_id, section, only_first, only_second, both): how the entities of each pair (first_id, second_id) differ, section by section.

    ``held`` is what :func:`sections` gives. Values are lists joined by commas; an entity that
    is not known has no sections, and its pairs no rows.
    """
    a = held.select(F.col("unique_id").alias("first_id"), "section", F.col("values").alias("x"))
    b = held.select(F.col("unique_id").alias("second_id"), "section", F.col("values").alias("y"))
    met = pairs.select("first_id", "second_id").distinct().join(a, "first_id").join(b, ["second_id", "section"])

    def text(c: Column) -> Column:
        return F.array_join(c, ",")

    return met.select("first_id", "second_id", "section", text(F.array_except("x", "y")).alias("only_first"), text(F.array_except("y", "x")).alias("only_second"), text(F.array_intersect("x", "y")).alias("both"))


def documents_of(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(unique_id, doc_id): the documents that are about each entity."""
    about = documents.select(norm_id("unique_id").alias("unique_id"), "doc_id").where("unique_id is not null and doc_id is not null").distinct()
    return about.join(entities.select("unique_id"), "unique_id", "left_semi")


def first_of(rows: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
    """(unique_id, n_name, name): how many values each key has, and the first ``most`` in order; a hub's list is never gathered whole."""
    counted = rows.groupBy(F.col(key).alias("unique_id")).agg(F.count("*").alias(f"n_{name}"))
    ranked = rows.select(F.col(key).alias("unique_id"), F.col(value).alias("v")).withColumn("r", F.row_number().over(W.partitionBy("unique_id").orderBy("v"))).where(F.col("r") <= most)
    return counted.join(ranked.groupBy("unique_id").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias(name)), "unique_id")


def contexts(entities: DataFrame, facts: DataFrame, edges: DataFrame, tests: DataFrame, documents: DataFrame, most: int = 5) -> DataFrame:
    """A row for each entity: what it is, how much is declared, and the first ``most`` of its parents, dependents, tests and documents, with their numbers."""
    parts = {
        "upstream": (edges, "child", "parent"), "downstream": (edges, "parent", "child"), "tests": (tests, "unique_id", "test_id"),
        "documents": (documents_of(documents, entities).withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0")), "unique_id", "doc_id"),
    }
    out = entities.select("unique_id", "resource_type", "entity_name", "package_name", "description").join(facts.select("unique_id", F.size("columns").alias("n_columns"), "measures", "metrics", "owner"), "unique_id", "left")
    for name, (rows, key, value) in parts.items():
        out = out.join(first_of(rows, key, value, most, name), "unique_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0))).withColumn(name, F.coalesce(name, F.lit("")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_columns", "measures", "metrics")}
    return out.withColumns(zero).withColumn("owner", F.coalesce("owner", F.lit(False)))


def detail(df: DataFrame, level: str, levels: dict[str, tuple[str, ...]]) -> DataFrame:
    """The columns of a level of detail; each level has those of the ones before it. Column pruning does the rest."""
    keep: list[str] = []
    for name, columns in levels.items():
        keep += [c for c in columns if c in df.columns]
        if name == level:
            return df.select(*keep)
    raise ValueError(f"unknown level of detail {level}")


#: What each level of detail of an entity adds.
LEVELS = {"minimal": ("unique_id", "entity_name", "resource_type"), "summary": ("package_name", "description", "tags"), "standard": ("database_name", "schema_name", "materialization"), "full": ("created_at", "deleted_at")}
