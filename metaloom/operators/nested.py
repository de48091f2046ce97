"""Deeply nested semi-structured records to related flat tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.jsonvalue import kind, parse, plain


@dataclass(frozen=True)
class Items:
    """A list whose texts and numbers are rows of ``child_kind``; a lone text or number is its only item."""

    child_kind: str


@dataclass(frozen=True)
class Records:
    """A list whose records are rows of ``child_kind`` if their field ``key`` is a text."""

    child_kind: str
    key: str
    columns: tuple[str, ...] = ()
    children: dict = field(default_factory=dict, hash=False)
    #: A field beside the list that, if not null, stands before the list's first element.
    before: str | None = None


@dataclass(frozen=True)
class Part:
    """A record that is no row of its own; its fields belong to the record above."""

    columns: tuple[str, ...] = ()
    children: dict = field(default_factory=dict, hash=False)


#: The subtypes of a semantic block and where they nest.
SEMANTIC_BLOCK = Part(children={
    "measures": Records("measure", "name", ("type", "expression", "description", "field", "canonical"), {"synonyms": Items("measure_synonym")}),
    "metrics": Records("metric", "name", ("expression", "description", "template", "canonical"), {
        "synonyms": Items("metric_synonym"),
        "grain": Part(("time_field",), {"primary_key": Items("grain_key"), "dimensions": Items("grain_dimension")}),
        "recommended_filters": Records("filter", "field", ("operator", "label"), {"values": Items("filter_value")}),
    }, before="metric"),
})

#: Columns that any subtype may have, besides its key.
ATTRIBUTES = ("type", "expression", "description", "field", "canonical", "template", "time_field", "operator", "label")
ROWS = (
    "block_id long, unique_id string, child_kind string, pos_a int, pos_b int, pos_c int, parent_kind string, parent_pos_a int, parent_pos_b int, "
    "variant string, value string, value_type string, " + ", ".join(f"{a} string" for a in ATTRIBUTES)
)


class ShapeAutomaton:
    """A bottom-up tree automaton over the shapes that the rules know.

    A value's state follows from the rule it stands under, its kind, and the states of its
    fields or elements; fields that no rule knows don't count. A state decides, once and for
    all values in it, which subtype's table the value goes to (:attr:`accept`), and names
    its structural variant. States are numbered as they are met. There are finitely many,
    whatever the values hold: a list's state is the set of its elements' kinds or subtypes.
    """

    def __init__(self):
        self.moves: dict[tuple, int] = {}
        self.accept: list[str | None] = []
        self.variants: list[str] = []

    def move(self, rule, what: str, below: tuple) -> int:
        at = self.moves.get((id(rule), what, below))
        if at is None:
            at = self.moves[id(rule), what, below] = len(self.accept)
            kinds = {(label, self.variants[s]) for label, s in below}
            if isinstance(rule, Records) and what == "record" and (rule.key, "text") in kinds:
                self.accept.append(rule.child_kind)
            else:
                self.accept.append(rule.child_kind if isinstance(rule, Items) and what in ("text", "number") else None)
            shown = ",".join(f"{label}:{name}" for label, name in sorted(kinds))
            self.variants.append(f"{{{shown}}}" if what == "record" else f"[{shown.replace(':', '')}]" if what == "list" else what)
        return at

    def record(self, value, rule) -> tuple[int, dict]:
        """State of a record under a rule, and what its children read as."""
        what, kids, below = kind(value) or "null", {}, []
        if what == "record":
            for label, sub in rule.children.items():
                if isinstance(sub, Part):
                    if label in value:
                        kids[label] = self.record(value[label], sub)
                        below.append((label, kids[label][0]))
                    continue
                held = value.get(label)
                first = value.get(sub.before) if isinstance(sub, Records) and sub.before else None
                if isinstance(sub, Items):
                    items = [(self.move(sub, kind(x) or "null", ()), x) for x in (held if isinstance(held, list) else [held])] if label in value else []
                    kids[label] = items
                    met = {("", s) for s, _ in items}
                else:
                    listed = ([] if first is None else [first]) + (held if isinstance(held, list) else [])
                    kids[label] = [(*self.record(x, sub), x) for x in listed]
                    # Of a list of records only their subtypes count, so that its states stay few.
                    met = {("", self.move(None, self.accept[s] or "other", ())) for s, _, _ in kids[label]}
                if label in value or first is not None:
                    below.append((label, self.move(None, "list" if first is not None or isinstance(held, list) else kind(held) or "null", tuple(sorted(met)))))
            own = (*rule.columns, rule.key) if isinstance(rule, Records) else rule.columns
            below += [(c, self.move(None, kind(value[c]) or "null", ())) for c in own if c in value]
        return self.move(rule, what, tuple(sorted(below))), kids


def block_of(payload) -> dict | None:
    """The semantic block: ``meta.nova``, or ``config.meta.nova`` if the first is no record."""
    config = payload.get("config") if isinstance(payload, dict) else None
    for holder in (payload, config):
        meta = holder.get("meta") if isinstance(holder, dict) else None
        block = meta.get("nova") if isinstance(meta, dict) else None
        if isinstance(block, dict):
            return block
    return None


def shown(value) -> str | None:
    """The value as a text; null if it nests too deeply to be written."""
    try:
        return plain(value)
    except RecursionError:
        return None


def flatten(block: dict, shapes: ShapeAutomaton) -> Iterator[tuple]:
    """(child_kind, positions, parent_kind, parent_positions, variant, value, type, attributes) of each child record.

    Every value is first read by the automaton; its state routes it.
    """

    def walk(kids: dict, rule, pos: tuple, parent: tuple):
        for label, sub in rule.children.items():
            if label not in kids:
                continue
            if isinstance(sub, Part):
                yield from walk(kids[label][1], sub, pos, parent)
            elif isinstance(sub, Items):
                for i, (state, item) in enumerate(kids[label]):
                    if (table := shapes.accept[state]) is not None:
                        what = shapes.variants[state]
                        yield table, (*pos, i), *parent, what, plain(item), what, {}
            else:
                for i, (state, below, item) in enumerate(kids[label]):
                    if (table := shapes.accept[state]) is not None:
                        own = {c: shown(item.get(c)) for c in sub.columns}
                        for part, inner in sub.children.items():
                            if isinstance(inner, Part) and isinstance(item.get(part), dict):
                                own |= {c: shown(item[part].get(c)) for c in inner.columns}
                        at = (*pos, i)
                        yield table, at, *parent, shapes.variants[state], plain(item[sub.key]), "text", own
                        yield from walk(below, sub, at, (table, at))

    yield from walk(shapes.record(block, SEMANTIC_BLOCK)[1], SEMANTIC_BLOCK, (), ("block", ()))


def child_records(blocks: DataFrame) -> DataFrame:
    """All child records of ``blocks`` (block_id, unique_id, payload_json), one row each, typed by child_kind.

    Method: a tree automaton reads each payload's values from below (:class:`ShapeAutomaton`);
    the state of a value names its structural variant and is what routes it to a subtype
    (``child_kind``), or nowhere. Every row keeps the common keys and the link to its parent
    (block_id, parent_kind, parent_pos_a, parent_pos_b). :func:`subtype_tables` splits the
    rows into typed tables.

    pos_a is the position of the measure or metric, pos_b of its synonym, grain item or
    filter, pos_c of a filter's value, all from 0 in the list as stored; unused ones are -1.
    Payloads that are null, blank or no JSON hold no records, nor do elements of the wrong
    type (see :class:`Records` and :class:`Items`). Repeated rows (same block_id) count once,
    of a repeated JSON key the last value holds. Further columns are ignored. Payloads of any
    length are read whole; one nested beyond Python's parser depth counts as no JSON. Fields that no
    rule knows may nest as deeply as that; an attribute too deep to be written is null.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes = ShapeAutomaton()
        names = [f.split()[0] for f in ROWS.split(", ")]
        for batch in batches:
            out = []
            for block_id, unique_id, text in batch.itertuples(index=False, name=None):
                try:
                    block = block_of(parse(text))
                    rows = list(flatten(block, shapes)) if block is not None else []
                except ValueError:
                    continue
                for what, pos, parent, above, variant, value, type_, own in rows:
                    a, b, c = (*pos, -1, -1)[:3]
                    pa, pb = (*above, -1, -1)[:2]
                    out.append((block_id, unique_id, what, a, b, c, parent, pa, pb, variant, value, type_, *(own.get(x) for x in ATTRIBUTES)))
            yield pd.DataFrame(out, columns=names).astype({"block_id": "Int64"})

    rows = blocks.select(F.col("block_id").cast("long"), "unique_id", "payload_json").where("payload_json is not null").mapInPandas(read, ROWS)
    return rows.dropDuplicates(["block_id", "child_kind", "pos_a", "pos_b", "pos_c"])


def subtype_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Each subtype's table: its link to block and parent, its key and its own columns."""
    link = ["block_id", "unique_id", "pos_a", "pos_b", "pos_c", "parent_kind", "parent_pos_a", "parent_pos_b", "variant"]
    out = {}

    def visit(rule):
        for sub in rule.children.values():
            if isinstance(sub, Items):
                out[sub.child_kind] = records.where(F.col("child_kind") == sub.child_kind).select(*link, "value", "value_type")
            elif isinstance(sub, Records):
                inner = [c for p in sub.children.values() if isinstance(p, Part) for c in p.columns]
                out[sub.child_kind] = records.where(F.col("child_kind") == sub.child_kind).select(*link, F.col("value").alias("name"), *sub.columns, *inner)
            if not isinstance(sub, Items):
                visit(sub)

    visit(SEMANTIC_BLOCK)
    return out
