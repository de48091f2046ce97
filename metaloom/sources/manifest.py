"""Project manifests, catalogs and JSON payloads as tables."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.jsonvalue import parse, plain
from metaloom.functions.scores import glob_regex

#: Sections whose entities have a type of their own.
SECTION_TYPES = {
    "sources": "source", "macros": "macro", "docs": "doc", "groups": "group", "exposures": "exposure", "metrics": "metric",
    "saved_queries": "saved_query", "semantic_models": "semantic_model", "unit_tests": "unit_test",
}
#: Layout of the stored tables.
SCHEMA_VERSION = 1
ENTITY = (
    "unique_id string, resource_type string, name string, alias string, package_name string, database string, schema string, path string, materialization string, "
    "description string, owner string, tags array<string>, raw_code string, compiled_code string, depends_on array<string>, attached_node string, column_name string, test_name string, "
    "nova string, ord long, payload_json string"
)
COLUMN = "unique_id string, column_name string, description string, data_type string, role string, semantic_type string, primary_key boolean, synonyms array<string>"


def overlay(base, top):
    """``top`` laid over ``base``: records merge field by field, null never overwrites, anything else does."""
    if isinstance(base, dict) and isinstance(top, dict):
        return {k: overlay(base.get(k), top.get(k)) for k in [*base, *[k for k in top if k not in base]]}
    return base if top is None else top


def merged_meta(entity: dict) -> dict:
    """The entity's ``meta`` over its ``config.meta``."""
    config = entity.get("config")
    under = config.get("meta") if isinstance(config, dict) else None
    found = overlay(under if isinstance(under, dict) else {}, entity.get("meta") if isinstance(entity.get("meta"), dict) else {})
    return found or {}


def as_bool(value) -> bool | None:
    text = plain(value)
    return None if text is None else {"true": True, "false": False}.get(text.strip().lower())


def texts(value) -> list[str]:
    """A list's texts; a lone text is its only one."""
    if isinstance(value, str):
        return [plain(value)]
    return [plain(x) for x in value if isinstance(x, str)] if isinstance(value, list) else []


def entity_row(section: str, uid: str, e: dict, ord_: int) -> dict:
    config = e.get("config") if isinstance(e.get("config"), dict) else {}
    deps = e.get("depends_on") if isinstance(e.get("depends_on"), dict) else {}
    meta = merged_meta(e)
    tm = e.get("test_metadata") if isinstance(e.get("test_metadata"), dict) else {}
    path = plain(e.get("original_file_path")) or plain(e.get("path"))
    return {
        "unique_id": plain(uid), "resource_type": SECTION_TYPES.get(section) or plain(e.get("resource_type")), "name": plain(e.get("name")), "alias": plain(e.get("alias")),
        "package_name": plain(e.get("package_name")), "database": plain(e.get("database")), "schema": plain(e.get("schema")), "path": path[2:] if path and path.startswith("./") else path,
        "materialization": plain(config.get("materialized")), "description": plain(e.get("description")), "owner": plain(meta.get("owner")), "tags": texts(e.get("tags")),
        "raw_code": plain(e.get("raw_code")) or plain(e.get("macro_sql")), "compiled_code": plain(e.get("compiled_code")), "depends_on": texts(deps.get("nodes")), "attached_node": plain(e.get("attached_node")),
        "column_name": plain(e.get("column_name")), "test_name": plain(tm.get("name")), "nova": json.dumps(meta["nova"]) if isinstance(meta.get("nova"), dict) else None, "ord": ord_, "payload_json": json.dumps(e),
    }


def entities(manifests: DataFrame) -> DataFrame:
    """The entities of manifests (content STRING, one document a row), in the manifest's order (``ord``); the first of a repeated id holds.

    Texts that are no JSON object have none. ``meta`` lies over ``config.meta``; a lone tag is a list of one.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ENTITY.split(", ")]
        for batch in batches:
            out = []
            for text in batch["content"]:
                try:
                    whole = parse(text)
                except ValueError:
                    continue
                n = 0
                for section in ("nodes", *SECTION_TYPES) if isinstance(whole, dict) else ():
                    held = whole.get(section)
                    items = held.items() if isinstance(held, dict) else ((x.get("unique_id"), x) for x in held if isinstance(x, dict)) if isinstance(held, list) else ()
                    for uid, e in items:
                        if isinstance(e, dict) and isinstance(uid, str):
                            out.append(entity_row(section, uid, e, n))
                            n += 1
            yield pd.DataFrame(out, columns=names)

    rows = manifests.select("content").where("content is not null").mapInPandas(read, ENTITY)
    return rows.groupBy("unique_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "unique_id"]), "ord").alias("x")).select("unique_id", "x.*")


def columns(found: DataFrame) -> DataFrame:
    """(unique_id, column_name, description, data_type, role, semantic_type, primary_key, synonyms) of each declared column."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in COLUMN.split(", ")]
        for batch in batches:
            out = []
            for uid, text in batch.itertuples(index=False, name=None):
                held = json.loads(text).get("columns")
                for name, c in held.items() if isinstance(held, dict) else ():
                    if not isinstance(c, dict):
                        continue
                    meta = merged_meta(c)
                    nova = meta.get("nova") if isinstance(meta.get("nova"), dict) else {}
                    out.append((uid, plain(name), plain(c.get("description")), plain(c.get("data_type")), plain(nova.get("role")), plain(nova.get("semantic_type")), as_bool(meta.get("primary_key")), texts(nova.get("synonyms"))))
            yield pd.DataFrame(out, columns=names)

    return found.select("unique_id", "payload_json").mapInPandas(read, COLUMN)


def dependency_edges(found: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(child, parent): those of a manifest's own parent_map where it has one that isn't empty, else of its entities' depends_on; decided for each manifest on its own."""
    own = found.select(F.col("unique_id").alias("child"), F.explode("depends_on").alias("parent")).distinct()
    if manifests is None:
        return own
    ups = F.from_json(F.get_json_object("content", "$.parent_map"), "map<string, array<string>>")
    told = manifests.select("content", ups.alias("ups"))
    listed = told.select(F.explode("ups").alias("child", "ps")).select("child", F.explode("ps").alias("parent"))
    bare = entities(told.where("ups is null or size(ups) = 0").select("content")).select(F.col("unique_id").alias("child"))
    return listed.unionByName(own.join(bare, "child", "left_semi")).distinct()


def attach_tests(found: DataFrame) -> DataFrame:
    """(unique_id, column_name, test_id, test_name): a test belongs to its attached node, with the column, and to all it depends on."""
    tests = found.where("resource_type in ('test', 'unit_test')")
    name = F.coalesce("test_name", F.lit("custom"))
    at = tests.where("attached_node is not null").select(F.col("attached_node").alias("node"), "column_name", F.col("unique_id").alias("test_id"), name.alias("test_name"))
    deps = tests.select(F.explode("depends_on").alias("node"), F.lit(None).cast("string").alias("column_name"), F.col("unique_id").alias("test_id"), name.alias("test_name"))
    deps = deps.join(at.select("node", "test_id"), ["node", "test_id"], "left_anti")
    return at.unionByName(deps.select(*at.columns)).distinct().withColumnRenamed("node", "unique_id")


def prune(found: DataFrame, allow: list[str], deny: list[str]) -> DataFrame:
    """Entities whose id fits an allowed pattern and no denied one; an analysis stays too if all it depends on, and at least one, does."""
    yes = F.lit(not allow)
    for p in allow:
        yes = yes | F.col("unique_id").rlike(glob_regex(p))
    no = F.lit(False)
    for p in deny:
        no = no | F.col("unique_id").rlike(glob_regex(p))
    kept = found.where(yes & ~no)
    more = found.where((F.col("resource_type") == "analysis") & ~no & ~yes & (F.size("depends_on") > 0))
    deps = more.select("unique_id", F.explode("depends_on").alias("dep")).join(kept.select(F.col("unique_id").alias("dep"), F.lit(1).alias("hit")), "dep", "left")
    whole = deps.groupBy("unique_id").agg(F.min(F.coalesce("hit", F.lit(0))).alias("all_")).where("all_ = 1").select("unique_id")
    return kept.unionByName(more.join(whole, "unique_id", "left_semi").select(*kept.columns))


def catalog_columns(catalogs: DataFrame) -> DataFrame:
    """(unique_id, column_name, catalog_type, comment) of catalogs (content STRING)."""
    spec = "map<string, struct<columns: map<string, struct<type: string, data_type: string, dtype: string, comment: string, description: string>>>>"
    both = F.concat(*[F.coalesce(F.map_entries(F.from_json(F.get_json_object("content", f"$.{s}"), spec)), F.array()) for s in ("nodes", "sources")])
    each = catalogs.select(F.explode(both).alias("e")).select(F.col("e.key").alias("unique_id"), F.explode("e.value.columns").alias("column_name", "c"))
    return each.select("unique_id", "column_name", F.coalesce("c.type", "c.data_type", "c.dtype").alias("catalog_type"), F.coalesce("c.comment", "c.description").alias("comment"))


def catalog_drift(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(unique_id, column_name, data_type, drift): declared and catalog columns met by name in any case; the catalog's type wins.

    drift is type_mismatch, catalog_only, missing_in_catalog, or null.
    """
    a = declared.select("unique_id", F.lower("column_name").alias("column_name"), "data_type")
    b = catalog.select("unique_id", F.lower("column_name").alias("column_name"), "catalog_type", F.lit(1).alias("there"))
    met = a.withColumn("declared", F.lit(1)).join(b, ["unique_id", "column_name"], "full_outer")
    drift = F.when(F.col("there").isNull(), "missing_in_catalog").when(F.col("declared").isNull(), "catalog_only").when(F.lower("data_type") != F.lower("catalog_type"), "type_mismatch")
    return met.select("unique_id", "column_name", F.coalesce("catalog_type", "data_type").alias("data_type"), drift.alias("drift"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (content): local, or of any file system that the session knows."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")


def signature_of(manifests: DataFrame, settings: str = "") -> str:
    """A name for the contents and the settings they are read with: equal for equal sets of contents, whatever their order or repeats.

    Two hashes of each content are combined bit by bit, so that nothing is gathered.
    """
    once = manifests.select(F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b")).distinct()
    a, b, n = once.agg(F.bit_xor("a"), F.bit_xor("b"), F.count("*")).first()
    return hashlib.sha256(f"{a} {b} {n} {settings}".encode()).hexdigest()[:16]


def write_version(tables: dict[str, DataFrame], folder: str, manifests: DataFrame, settings: str = "") -> str:
    """Write tables below ``folder/versions/<signature>``; a version that is there already is kept. Returns its path.

    The pointer to the current version is added to, never overwritten, so a reader always
    finds one: the last added.
    """
    spark = manifests.sparkSession
    path = f"{folder}/versions/{signature_of(manifests, settings)}"
    for name, df in tables.items():
        df.write.mode("ignore").parquet(f"{path}/{name}")
    pointer = spark.range(1).select(F.lit(path).alias("path"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(time.time_ns()).alias("at"))
    pointer.coalesce(1).write.mode("append").json(f"{folder}/current")
    return path


def read_current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current version; one written by another version of the tables' layout is refused."""
    path, version = spark.read.schema("path string, schema_version int, at long").json(f"{folder}/current").agg(F.max_by("path", "at"), F.max_by("schema_version", "at")).first()
    if version != SCHEMA_VERSION:
        raise ValueError(f"tables of layout {version}, not {SCHEMA_VERSION}; write them again")
    return spark.read.parquet(f"{path}/{name}")
