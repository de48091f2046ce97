"""What the latest payload of each entity says: about itself, its semantic block, and its columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.jsonvalue import kind, parse, plain
from metaloom.functions.text import norm_id
from metaloom.operators.nested import block_of

COLUMN = (
    "column_name string, data_type string, description string, owner boolean, primary_key boolean, role string, semantic_type string, synonyms array<string>, examples array<string>, "
    "sensitivity boolean, pii boolean, governance boolean, compliance int, constraints int, key_constraints int, type_mismatch boolean, missing_in_catalog boolean, catalog_only boolean"
)
METRIC = "name string, expression string, template boolean, canonical boolean, keys array<string>, time_field string, dimensions array<string>, grain boolean, synonyms array<string>"
MEASURE = "name string, field string, canonical boolean, synonyms array<string>"
ENTITY = (
    "unique_id string, payload_description string, owner boolean, has_block boolean, role string, canonical_indicator boolean, sensitivity string, pii string, compliance int, synonyms int, domains int, use_cases int, "
    "grain boolean, grain_keys array<string>, time_field string, dimensions array<string>, metric_grains int, measures int, measure_expression boolean, measure_synonyms boolean, metrics int, metric_expression boolean, metric_synonyms boolean, "
    "measure_names array<string>, measure_fields array<string>, metric_names array<string>, metric_expressions array<string>, metric_time_fields int, canonical_names array<string>, "
    "relation_name string, block_canonical boolean, analyst boolean, governed boolean, measure_refs array<string>"
)


def as_struct(fields: str) -> str:
    return f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"


def record(value) -> dict:
    return value if isinstance(value, dict) else {}


def listed(value) -> list:
    return value if isinstance(value, list) else []


def texts(value) -> list[str]:
    """A list's texts; a lone text is its only one."""
    return [plain(x) for x in (value if isinstance(value, list) else [value]) if kind(x) == "text" and x.strip()]


def meta_field(holder: dict, name: str):
    """A field of ``meta``, or of ``config.meta`` where that lacks it."""
    for meta in (holder.get("meta"), record(holder.get("config")).get("meta")):
        if record(meta).get(name) is not None:
            return meta[name]
    return None


def filled(value) -> bool:
    """Whether a value says something: no null, blank text, empty list or record."""
    return bool(value.strip()) if isinstance(value, str) else len(value) > 0 if isinstance(value, (list, dict)) else value is not None


def owned(holder: dict) -> bool:
    owner = meta_field(holder, "owner")
    return filled(owner if owner is not None else holder.get("owner"))


def truthy(value) -> bool:
    return value is True or (isinstance(value, str) and value.strip().lower() in ("true", "yes", "1"))


def column_row(name: str, column: dict) -> tuple:
    block = record(meta_field(column, "nova"))
    governance = record(block.get("governance"))
    key = meta_field(column, "primary_key")
    kinds = [record(c).get("type") for c in listed(column.get("constraints"))]
    description = column.get("description")
    return (
        plain(name), plain(column.get("data_type")), plain(description) if kind(description) == "text" else None, owned(column), truthy(key), plain(block.get("role")), plain(block.get("semantic_type")),
        texts(block.get("synonyms")), texts(block.get("examples")), kind(governance.get("sensitivity")) == "text", governance.get("pii") is not None, bool(governance), len(listed(governance.get("compliance"))),
        len(kinds), sum(k in ("not_null", "unique", "foreign_key") for k in kinds), *(record(column.get("catalog_drift")).get(k) is True for k in ("type_mismatch", "missing_in_catalog", "catalog_only")),
    )


def metric_row(metric: dict) -> tuple:
    grain = record(metric.get("grain"))
    return (
        plain(metric["name"]), plain(metric.get("expression")), metric.get("template") is True, metric.get("canonical") is True, texts(grain.get("primary_key")), plain(grain.get("time_field")), texts(grain.get("dimensions")), bool(grain), texts(metric.get("synonyms"))
    )


def measure_names_of(payload: dict) -> list[str]:
    """Measures that a semantic metric's own definition refers to, by name."""
    out = []
    for key in ("measure", "numerator", "denominator"):
        held = record(payload.get("type_params")).get(key)
        name = held.get("name") if isinstance(held, dict) else held
        if kind(name) == "text":
            out.append(plain(name))
    for held in listed(record(payload.get("type_params")).get("input_measures")):
        name = held.get("name") if isinstance(held, dict) else held
        if kind(name) == "text":
            out.append(plain(name))
    return sorted(set(out))


def entity_row(unique_id: str, payload: dict) -> tuple:
    found = block_of(payload)
    block = found or {}
    governance, grain = record(block.get("governance")), record(block.get("grain"))
    measures = [m for m in listed(block.get("measures")) if isinstance(m, dict)]
    held = block.get("metrics") if block.get("metrics") is not None else block.get("metric")
    listed_metrics = held if isinstance(held, list) else [held] if isinstance(held, dict) else []
    metrics = [m for m in listed_metrics if isinstance(m, dict)]
    if isinstance(block.get("metric"), dict) and held is not block.get("metric"):
        every = [block["metric"], *metrics]
    else:
        every = metrics
    grains = [record(m.get("grain")) for m in every]
    canonical = [plain(m["name"]) for m in (*measures, *every) if m.get("canonical") is True and kind(m.get("name")) == "text"]
    description = payload.get("description")
    return (
        unique_id, plain(description) if kind(description) == "text" else None, owned(payload), found is not None, plain(block.get("role")),
        bool(canonical) or any(m.get("canonical") is True for m in (*measures, *every)) or (block.get("canonical") is True and bool(measures or every)),
        plain(governance.get("sensitivity")), plain(governance.get("pii")), len(listed(governance.get("compliance"))),
        len(listed(block.get("synonyms"))), len(listed(block.get("domains"))), len(listed(block.get("use_cases"))),
        bool(grain) or any(grains), texts(grain.get("primary_key")), plain(grain.get("time_field")), texts(grain.get("dimensions")), len({plain(g) for g in grains if g}),
        len(listed(block.get("measures"))), any("expression" in m for m in measures), any(listed(m.get("synonyms")) for m in measures),
        len(listed_metrics), any("expression" in m for m in metrics), any(listed(m.get("synonyms")) for m in metrics),
        [plain(m["name"]) for m in measures if kind(m.get("name")) == "text"], [plain(m["field"]) for m in measures if kind(m.get("field")) == "text"], [plain(m["name"]) for m in every if kind(m.get("name")) == "text"],
        [plain(m["expression"]) for m in every if kind(m.get("expression")) == "text"], sum(kind(g.get("time_field")) == "text" for g in grains), sorted(set(canonical)),
        plain(payload.get("relation_name")), block.get("canonical") is True, record(record(block.get("search")).get("candidates")).get("analyst") is not False, block.get("governance") is not None, measure_names_of(payload),
        [metric_row(m) for m in every if kind(m.get("name")) == "text"],
        [(plain(m["name"]), plain(m.get("field")), m.get("canonical") is True, texts(m.get("synonyms"))) for m in measures if kind(m.get("name")) == "text"],
    )


def payload_facts(blocks: DataFrame) -> DataFrame:
    """A row for each entity with a readable latest payload: the fields of ENTITY, its metrics, measures and columns as lists of records.

    The latest payload is the one captured last (then that of the largest block_id). If it is
    no JSON object the entity says nothing. Repeated keys of a record: the last counts.
    """
    names = [f.strip().split(" ")[0] for f in ENTITY.split(",")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for unique_id, text in batch.itertuples(index=False, name=None):
                try:
                    payload = parse(text)
                except ValueError:
                    continue
                if isinstance(payload, dict):
                    columns = [column_row(n, c) for n, c in record(payload.get("columns")).items() if isinstance(c, dict)]
                    out.append((*entity_row(unique_id, payload), columns))
            yield pd.DataFrame(out, columns=[*names, "metric_list", "measure_list", "columns"], dtype=object)

    last = blocks.where("payload_json is not null").select(norm_id("unique_id").alias("unique_id"), F.struct("captured_at", "block_id", "payload_json").alias("x")).where("unique_id is not null")
    latest = last.groupBy("unique_id").agg(F.max("x").alias("x")).select("unique_id", "x.payload_json")
    return latest.mapInPandas(read, f"{ENTITY}, metric_list {as_struct(METRIC)}, measure_list {as_struct(MEASURE)}, columns {as_struct(COLUMN)}")


def columns_of(facts: DataFrame) -> DataFrame:
    """(unique_id, and the fields of COLUMN) of each declared column."""
    return facts.select("unique_id", F.explode("columns").alias("c")).select("unique_id", "c.*")


def column_tests(entities: DataFrame, tests: DataFrame) -> DataFrame:
    """(unique_id, column_name, kind): the tests of a column, told by a test's name: its kind, the entity's name, the column's name."""
    name = F.element_at(F.split("test_id", r"\."), 3)
    kind_ = F.regexp_extract(name, "^(not_null|unique|accepted_values|relationships)_", 1)
    named = tests.withColumn("kind", kind_).where("kind <> ''").join(entities.select("unique_id", F.lower("entity_name").alias("entity_name")), "unique_id")
    rest = F.substring(F.element_at(F.split("test_id", r"\."), 3), F.length("kind") + 2, F.length("test_id"))
    begins = F.concat("entity_name", F.lit("_"))
    out = named.withColumn("rest", rest).where(F.startswith(F.col("rest"), begins))
    return out.select("unique_id", F.substring(F.col("rest"), F.length("entity_name") + 2, F.length("rest")).alias("column_name"), "kind").distinct()
