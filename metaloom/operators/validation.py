"""Rules that the semantic block of a payload must keep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.jsonvalue import kind, parse, plain
from metaloom.operators.nested import block_of
from metaloom.operators.payloads import listed, record

#: How many values each filter operator takes, from and to.
ARITY = {"in": (1, 1 << 30), "not_in": (1, 1 << 30), "between": (2, 2), "is_null": (0, 0), "is_not_null": (0, 0), "=": (1, 1), "!=": (1, 1), ">": (1, 1), ">=": (1, 1), "<": (1, 1), "<=": (1, 1)}
#: Each rule's severity.
SEVERITY = {
    "schema_violation": "error", "metric_and_metrics_conflict": "error", "duplicate_measure_name": "error", "duplicate_metric_name": "error", "duplicate_semantic_name": "error", "duplicate_primary_key": "error", "duplicate_dimension": "error",
    "grain_field_overlap": "warning", "measure_missing_expression": "warning", "measure_missing_description": "warning", "metric_missing_grain": "warning", "metric_missing_template": "warning", "metric_missing_expression": "warning",
    "empty_recommended_filters": "warning", "unsupported_filter_operator": "error", "invalid_filter_values": "error", "blank_operator": "error", "blank_string": "error", "blank_array_value": "error", "empty_array": "warning", "duplicate_array_value": "warning",
    "missing_referenced_field": "error", "canonical_analyst_deboost_conflict": "warning", "duplicate_canonical_surface": "error", "canonical_indicator_conflict": "error",
}
#: What kind of value each field of the block holds.
SHAPES = {
    "measures": "list", "metric": "record", "metrics": "list", "grain": "record", "governance": "record", "search": "record", "synonyms": "list", "domains": "list", "use_cases": "list", "role": "text", "canonical": "boolean",
}


def name_of(value: dict) -> str:
    return plain(value["name"]).strip().lower() if kind(value.get("name")) == "text" else ""


def repeats(values: list) -> list[str]:
    """Values, case and surrounding blanks aside, that come again, each once."""
    seen, out = set(), []
    for v in values:
        low = (plain(v) or "").strip().lower()
        if low in seen and low not in out:
            out.append(low)
        seen.add(low)
    return out


def grain_rules(grain: dict, path: str, columns: set[str]) -> Iterator[tuple[str, str]]:
    keys, dims, time = listed(grain.get("primary_key")), listed(grain.get("dimensions")), grain.get("time_field")
    keys = keys or ([grain["primary_key"]] if kind(grain.get("primary_key")) == "text" else [])
    for v in repeats(keys):
        yield "duplicate_primary_key", f"{path}.primary_key: {v}"
    for v in repeats(dims):
        yield "duplicate_dimension", f"{path}.dimensions: {v}"
    both = {(plain(k) or "").lower() for k in keys} & {(plain(d) or "").lower() for d in dims}
    for v in sorted(both):
        yield "grain_field_overlap", f"{path}: {v}"
    if kind(time) == "text" and any((plain(d) or "").lower() == time.lower() for d in dims):
        yield "grain_field_overlap", f"{path}.time_field: {plain(time)}"
    for place, values in (("primary_key", keys), ("dimensions", dims), ("time_field", [time] if kind(time) == "text" else [])):
        for v in values:
            yield from field_rule(v, f"{path}.{place}", columns)


def field_rule(value, path: str, columns: set[str]) -> Iterator[tuple[str, str]]:
    if kind(value) != "text":
        return
    if not value.strip():
        yield "blank_string", path
    elif columns and value not in columns:
        yield "missing_referenced_field", f"{path}: {plain(value)}"


def metric_rules(metric: dict, path: str, columns: set[str]) -> Iterator[tuple[str, str]]:
    if isinstance(metric.get("grain"), dict):
        yield from grain_rules(metric["grain"], f"{path}.grain", columns)
    else:
        yield "metric_missing_grain", path
    if metric.get("template") is not True:
        yield "metric_missing_template", path
    if "expression" not in metric:
        yield "metric_missing_expression", path
    filters = metric.get("recommended_filters")
    if filters == []:
        yield "empty_recommended_filters", path
    for i, f in enumerate(listed(filters)):
        if not isinstance(f, dict):
            continue
        at = f"{path}.recommended_filters[{i}]"
        yield from field_rule(f.get("field"), f"{at}.field", columns)
        op = f.get("operator")
        low = op.strip().lower() if kind(op) == "text" else ""
        values = f.get("values")
        many = len(values) if isinstance(values, list) else 0 if values is None else 1
        if not low:
            yield "blank_operator", at
        elif low not in ARITY:
            yield "unsupported_filter_operator", f"{at}: {plain(op)}"
        elif not ARITY[low][0] <= many <= ARITY[low][1]:
            yield "invalid_filter_values", f"{at}: {low} takes other than {many}"


def list_rules(values, path: str) -> Iterator[tuple[str, str]]:
    if values == []:
        yield "empty_array", path
    for i, v in enumerate(listed(values)):
        if kind(v) == "text" and not v.strip():
            yield "blank_array_value", f"{path}[{i}]"
    for v in repeats([v for v in listed(values) if kind(v) == "text" and v.strip()]):
        yield "duplicate_array_value", f"{path}: {v}"


def block_rules(payload: dict) -> Iterator[tuple[str, str]]:
    """(code, where) of each rule that a payload's block breaks. Without a block there are none; fields are looked up among the declared columns, if there are any."""
    block = block_of(payload)
    if block is None:
        return
    columns = {plain(c) for c in record(payload.get("columns"))}
    for name, what in SHAPES.items():
        if block.get(name) is not None and kind(block[name]) != what:
            yield "schema_violation", f"{name} is no {what}"
    if "metric" in block and "metrics" in block:
        yield "metric_and_metrics_conflict", "metric, metrics"
    if isinstance(block.get("grain"), dict):
        yield from grain_rules(block["grain"], "grain", columns)
    measures = [m for m in listed(block.get("measures")) if isinstance(m, dict)]
    metrics = ([("metric", block["metric"])] if isinstance(block.get("metric"), dict) else []) + [(f"metrics[{i}]", m) for i, m in enumerate(listed(block.get("metrics"))) if isinstance(m, dict)]
    for i, m in enumerate(listed(block.get("measures"))):
        if not isinstance(m, dict):
            continue
        at = f"measures[{i}]"
        yield from field_rule(m.get("field"), f"{at}.field", columns)
        if m.get("field") is not None and "expression" not in m:
            yield "measure_missing_expression", at
        if "description" not in m:
            yield "measure_missing_description", at
        yield from list_rules(m.get("synonyms"), f"{at}.synonyms")
    for at, m in metrics:
        yield from metric_rules(m, at, columns)
        yield from list_rules(m.get("synonyms"), f"{at}.synonyms")
    names = {"duplicate_measure_name": [n for m in measures if (n := name_of(m))], "duplicate_metric_name": [n for _, m in metrics if (n := name_of(m))]}
    for code, held in names.items():
        for v in repeats(held):
            yield code, v
    for v in sorted(set(names["duplicate_measure_name"]) & set(names["duplicate_metric_name"])):
        yield "duplicate_semantic_name", v
    for at, m in [*((f"measures[{i}]", m) for i, m in enumerate(listed(block.get("measures"))) if isinstance(m, dict)), *metrics]:
        if kind(m.get("name")) == "text" and not m["name"].strip():
            yield "blank_string", f"{at}.name"
    if kind(block.get("role")) == "text" and not block["role"].strip():
        yield "blank_string", "role"
    for name in ("synonyms", "domains", "use_cases"):
        yield from list_rules(block.get(name), name)
    yield from list_rules(record(block.get("governance")).get("compliance"), "governance.compliance")
    if block.get("canonical") is True and record(record(block.get("search")).get("candidates")).get("analyst") is False:
        yield "canonical_analyst_deboost_conflict", "search.candidates.analyst"


def validate_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id, code, severity, evidence): the rules (:data:`SEVERITY`) that each payload's semantic block breaks.

    ``blocks`` has block_id, unique_id and payload_json; repeated rows (same block_id) count once,
    payloads that are no JSON object break none. Rules within one block are read off it in
    one pass; canonical names that several entities claim are counted over all blocks: each
    claim is a canonical_indicator_conflict, an entity's own several canonical surfaces of one
    name a duplicate_canonical_surface.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block_id, unique_id, text in batch.itertuples(index=False, name=None):
                try:
                    payload = parse(text)
                except ValueError:
                    continue
                if not isinstance(payload, dict):
                    continue
                out += [(block_id, code, where, None, None) for code, where in block_rules(payload)]
                block = block_of(payload) or {}
                every = [("measure", m) for m in listed(block.get("measures"))] + [("metric", m) for m in (block.get("metric"), *listed(block.get("metrics")))]
                out += [(block_id, None, None, unique_id, f"{what} {name_of(m)}") for what, m in every if isinstance(m, dict) and m.get("canonical") is True and name_of(m)]
            yield pd.DataFrame(out, columns=["block_id", "code", "evidence", "unique_id", "label"], dtype=object)

    held = blocks.select(F.col("block_id").cast("long"), F.lower(F.trim("unique_id")).alias("unique_id"), "payload_json").where("payload_json is not null and block_id is not null").dropDuplicates(["block_id"])
    rows = held.mapInPandas(read, "block_id long, code string, evidence string, unique_id string, label string")
    claims = rows.where("label is not null").groupBy("label", "unique_id", "block_id").agg(F.count("*").alias("n"))
    contested = claims.groupBy("label").agg(F.countDistinct("unique_id").alias("entities")).where("entities > 1").select("label")
    conflict = claims.join(contested, "label", "left_semi").select("block_id", F.lit("canonical_indicator_conflict").alias("code"), F.col("label").alias("evidence"))
    double = claims.where("n > 1").select("block_id", F.lit("duplicate_canonical_surface").alias("code"), F.col("label").alias("evidence"))
    every = rows.where("code is not null").select("block_id", "code", "evidence").unionByName(conflict).unionByName(double)
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("code"))
    return every.select("block_id", "code", severity.alias("severity"), "evidence")
