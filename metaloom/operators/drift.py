"""Schemas that drift between files."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.functions.jsonvalue import kind, parse, plain
from metaloom.session import cut_lineage

SECTIONS = ("metadata", "nodes")
#: Type promotion: what two types have in common. A field without a known type takes any.
LATTICE_TOP = "text"


def promote(a: str | None, b: str | None) -> str | None:
    """The least type that holds values of both: a type is above unknown and below text."""
    if a is None or a == b:
        return b
    return a if b is None else LATTICE_TOP


def values(record: dict, path: str) -> Iterator[tuple[str, object]]:
    """Dotted path and value of every field below ``path`` that is no record."""
    for key, value in record.items():
        if isinstance(value, dict):
            yield from values(value, f"{path}.{key}")
        else:
            yield plain(f"{path}.{key}"), value


#: Files of a project are followed in blocks of so many numbers; each block is a task's work.
BLOCK_FILES = 4096
#: Columns of a united table; a schema with more fields is given in long form only.
MAX_COLUMNS = 2000


def sections(whole) -> Iterator[tuple[str, int, str, dict]]:
    """(section, place, id, record) of each record of a file."""
    for section in SECTIONS:
        held = whole.get(section)
        for i, record in enumerate(held if isinstance(held, list) else [held]):
            if isinstance(record, dict):
                yield section, i, (plain(record.get("unique_id")) if section == "nodes" else None) or str(i), record


def present(files: DataFrame) -> DataFrame:
    return files.select("project_name", "file_seq", "content").where("project_name is not null and file_seq is not null and content is not null")


def parsed(text: str) -> dict | None:
    try:
        whole = parse(text)
    except ValueError:
        return None
    return whole if isinstance(whole, dict) else None


def file_schemas(files: DataFrame) -> DataFrame:
    """(project_name, file_seq, schema), a row for each file: its fields' paths with their types, as a JSON object in order of paths.

    A type is text, number, boolean or list, null if all values are null; should a file's
    nodes disagree, it is the promoted type. Files whose content is null or no JSON object,
    and such without project or number, are not present.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, seq, text in batch.itertuples(index=False, name=None):
                whole = parsed(text)
                if whole is None:
                    continue
                found: dict[str, str | None] = {}
                for section, _, _, record in sections(whole):
                    for path, value in values(record, section):
                        found[path] = promote(found.get(path), kind(value))
                out.append((project, seq, json.dumps(found, sort_keys=True)))
            yield pd.DataFrame(out, columns=["project_name", "file_seq", "schema"])

    return present(files).mapInPandas(read, "project_name string, file_seq int, schema string")


class Follower:
    """A project's files in order: what the last file had, and each path's last known type and where."""

    def __init__(self, last: str | None = None, known: str | None = None):
        self.last: dict | None = None if last is None else json.loads(last)
        self.known: dict[str, list] = {} if known is None else json.loads(known)

    def step(self, seq: int, schema: dict) -> Iterator[tuple]:
        """(path, what, old_type, new_type, old_seq) of each difference to the file before: came, went or retyped."""
        if self.last is not None and schema is not self.last:
            for path in sorted(schema.keys() | self.last.keys()):
                before, at = self.known.get(path, (None, None))
                now = schema.get(path)
                if path not in self.last:
                    yield path, "came", None, now, None
                elif path not in schema:
                    yield path, "went", before, None, at
                elif now is not None and before is not None and now != before:
                    yield path, "retyped", before, now, None
        for path, what in schema.items():
            if what is not None:
                self.known[path] = [what, seq]
        self.last = schema


def in_order(pdf: pd.DataFrame) -> Iterator[tuple[int, dict]]:
    """(file_seq, schema) in order; equal schemas in a row are one object. Files of equal number count as one, with the fields of all."""
    last_text, last = None, None
    order = pdf["file_seq"].to_numpy().argsort(kind="stable")
    rows = zip(pdf["file_seq"].to_numpy()[order].tolist(), pdf["schema"].to_numpy(object)[order].tolist(), strict=True)
    for seq, same in itertools.groupby(rows, key=lambda r: r[0]):
        found = sorted({text for _, text in same})
        if len(found) == 1 and found[0] == last_text:
            yield seq, last
            continue
        whole: dict = {}
        for t in found:
            for path, what in json.loads(t).items():
                whole[path] = promote(whole.get(path), what)
        last_text, last = found[0] if len(found) == 1 else None, whole
        yield seq, whole


def differences(schemas: DataFrame, block: int = BLOCK_FILES) -> tuple[DataFrame, DataFrame]:
    """(project_name, file_seq, field_path, what, old_type, new_type, old_seq) of each difference between files in a row, and the ends of all blocks.

    Each block of a project is folded in two passes: the first leaves what its last file had,
    its paths' last known types, and their types folded through the lattice; these
    ends, one row a block, are carried from block to block; the second pass starts from them.
    """
    keyed = schemas.withColumn("block", F.floor(F.col("file_seq") / block))

    def end(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, folded, count = Follower(), {}, {}
        for seq, schema in in_order(pdf):
            for _ in at.step(seq, schema):
                pass
            for path, what in schema.items():
                folded[path] = promote(folded.get(path), what)
                count[path] = count.get(path, 0) + 1
        types = json.dumps({path: [what, count[path]] for path, what in folded.items()})
        return pd.DataFrame([(*key, json.dumps(at.last), json.dumps(at.known), types)], columns=["project_name", "block", "last", "known", "types"])

    ends = cut_lineage(keyed.groupBy("project_name", "block").applyInPandas(end, "project_name string, block long, last string, known string, types string"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last, known = [], None, {}
        for project, b, at_end, more in pdf.sort_values("block").itertuples(index=False, name=None):
            out.append((project, b, last, json.dumps(known)))
            last = at_end
            known |= json.loads(more)
        return pd.DataFrame(out, columns=["project_name", "block", "last", "known"])

    begins = ends.select("project_name", "block", "last", "known").groupBy("project_name").applyInPandas(carry, "project_name string, block long, last string, known string")

    def follow(key: tuple, pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        at, out = Follower(begin["last"].iloc[0], begin["known"].iloc[0]), []
        for seq, schema in in_order(pdf):
            out += [(key[0], seq, *x) for x in at.step(seq, schema)]
        return pd.DataFrame(out, columns=["project_name", "file_seq", "field_path", "what", "old_type", "new_type", "old_seq"]).astype({"old_seq": "Int64"})

    fields = "project_name string, file_seq int, field_path string, what string, old_type string, new_type string, old_seq int"
    return keyed.groupBy("project_name", "block").cogroup(begins.groupBy("project_name", "block")).applyInPandas(follow, fields), ends


def path_contents(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_name, file_seq, field_path, content): for the paths wanted of some files a hash of each (node, value) that is not null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, seq, text, paths in batch.itertuples(index=False, name=None):
                whole, found = parsed(text), {p: [] for p in paths}
                for section, _, who, record in sections(whole) if whole is not None else ():
                    for path, value in values(record, section):
                        if path in found and value is not None:
                            found[path].append(xxhash.xxh64_intdigest(f"{who}\0{plain(value)}") - 2**63)
                out += [(project, seq, path, sorted(set(hashes))) for path, hashes in found.items() if hashes]
            yield pd.DataFrame(out, columns=["project_name", "file_seq", "field_path", "content"])

    paths = wanted.groupBy("project_name", "file_seq").agg(F.collect_set("field_path").alias("paths"))
    read_again = present(files).join(paths, ["project_name", "file_seq"]).select("project_name", "file_seq", "content", "paths")
    # A file that came twice has the same content twice.
    return read_again.mapInPandas(read, "project_name string, file_seq int, field_path string, content array<long>").dropDuplicates(["project_name", "file_seq", "field_path"])


def schema_changes(files: DataFrame, schemas: DataFrame, block: int = BLOCK_FILES) -> tuple[DataFrame, DataFrame]:
    """(project_name, file_seq, field_path, change_kind, old_path, old_type, new_type), a row for each change of a file, and the ends of :func:`differences`.

    A file is compared with the project's file of the next lower number present. Method:
    schemas are read from all files in parallel (:func:`file_schemas`), a row a file, and
    folded in order through the type lattice (:func:`differences`), in blocks, so that no
    project is one task. Only where a field vanishes and another of the section appears
    are the two paths' contents read (:func:`path_contents`).

    change_kind is ``added``, ``removed``, ``retyped`` (the type differs from the last one
    known of the path) or ``renamed`` (a field vanishes and another of the same section, in
    the same file, has its content: at least one node's value that is not null agrees; of
    several candidates the one with the largest agreeing share, then the most similar name,
    taken only where it is the best for both).
    """
    met, ends = differences(schemas, block)
    met = cut_lineage(met.withColumn("section", F.substring_index("field_path", ".", 1)))
    came, went = met.where("what = 'came'"), met.where("what = 'went'")

    key = ["project_name", "file_seq", "section"]
    turned_up = came.where("new_type is not null").join(went.where("old_seq is not null").select(*key).distinct(), key, "left_semi")
    gone = went.where("old_seq is not null").join(came.where("new_type is not null").select(*key).distinct(), key, "left_semi")
    wanted = turned_up.select("project_name", "file_seq", "field_path").unionByName(gone.select("project_name", F.col("old_seq").alias("file_seq"), "field_path")).distinct()
    contents = cut_lineage(path_contents(files, wanted))
    to = turned_up.join(contents, ["project_name", "file_seq", "field_path"]).select(
        *key, F.col("field_path").alias("new_path"), "new_type", F.size("content").alias("n"), F.explode("content").alias("h")
    )
    fro = gone.join(contents.withColumnRenamed("file_seq", "old_seq"), ["project_name", "old_seq", "field_path"]).select(
        *key, F.col("field_path").alias("old_path"), "old_type", F.size("content").alias("m"), F.explode("content").alias("h")
    )
    both = to.join(fro, [*key, "h"]).groupBy(*key, "new_path", "old_path").agg(
        (F.count("*") / F.greatest(F.first("n"), F.first("m"))).alias("share"), F.first("new_type").alias("new_type"), F.first("old_type").alias("old_type")
    )
    near = -F.levenshtein(F.lower("new_path"), F.lower("old_path"))
    best = [F.desc("share"), F.desc("near"), "new_path", "old_path"]
    ranked = both.withColumn("near", near).select(
        "*", F.row_number().over(W.partitionBy(*key, "new_path").orderBy(*best)).alias("r"), F.row_number().over(W.partitionBy(*key, "old_path").orderBy(*best)).alias("s")
    )
    renamed = cut_lineage(ranked.where("r = 1 and s = 1").select("project_name", "file_seq", "new_path", "old_path", "old_type", "new_type"))

    nothing = F.lit(None).cast("string")
    at = ["project_name", "file_seq", "field_path"]
    new_names = renamed.select("project_name", "file_seq", F.col("new_path").alias("field_path"))
    old_names = renamed.select("project_name", "file_seq", F.col("old_path").alias("field_path"))
    added = came.join(new_names, at, "left_anti").select(*at, F.lit("added").alias("change_kind"), nothing.alias("old_path"), nothing.alias("old_type"), "new_type")
    removed = went.join(old_names, at, "left_anti").select(*at, F.lit("removed").alias("change_kind"), nothing.alias("old_path"), "old_type", nothing.alias("new_type"))
    moved = renamed.select("project_name", "file_seq", F.col("new_path").alias("field_path"), F.lit("renamed").alias("change_kind"), "old_path", "old_type", "new_type")
    retyped = met.where("what = 'retyped'").select(*at, F.lit("retyped").alias("change_kind"), nothing.alias("old_path"), "old_type", "new_type")
    turned = moved.where("new_type <> old_type").withColumn("change_kind", F.lit("retyped"))
    return added.unionByName(removed).unionByName(moved).unionByName(retyped).unionByName(turned), ends


def united_fields(schemas: DataFrame, changes: DataFrame, ends: DataFrame) -> DataFrame:
    """(project_name, field_path, field, type): each path's field in the united schema, and its type there.

    Paths that renames of the project link are one field, named after the path that most of
    the project's files have (of equal ones the smallest), unless one file has both. A field's type
    is the promotion of the types of its paths over all projects; without any it is text.
    Everything stays distributed; a task has the paths of one project.
    """
    found = ends.select("project_name", F.explode(F.from_json("types", "map<string,array<string>>")).alias("field_path", "x"))
    seen = found.groupBy("project_name", "field_path").agg(F.array_compact(F.collect_set(F.col("x")[0])).alias("types"), F.sum(F.col("x")[1].cast("long")).alias("files"))
    pairs = changes.where("change_kind = 'renamed'").select("project_name", F.col("old_path").alias("a"), F.col("field_path").alias("b")).distinct()
    held = F.from_json("schema", "map<string,string>")
    together = schemas.join(pairs, "project_name").where(F.map_contains_key(held, F.col("a")) & F.map_contains_key(held, F.col("b"))).select("project_name", "a", "b").distinct()
    pairs = pairs.join(together, ["project_name", "a", "b"], "left_anti")

    def unite(key: tuple, paths: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        lead = {p: p for p in paths["field_path"]}

        def head(path: str) -> str:
            while lead[path] != path:
                path = lead[path]
            return path

        for a, b in sorted(zip(links["a"], links["b"], strict=True)):
            if a in lead and b in lead:
                a, b = sorted((head(a), head(b)))
                lead[b] = a
        best: dict[str, tuple] = {}
        for path, n in zip(paths["field_path"], paths["files"], strict=True):
            best[head(path)] = min(best.get(head(path), (0, "")), (-n, path))
        return pd.DataFrame({"project_name": key[0], "field_path": list(lead), "field": [best[head(p)][1] for p in lead]})

    fields = seen.select("project_name", "field_path", "files").groupBy("project_name").cogroup(pairs.groupBy("project_name"))
    named = fields.applyInPandas(unite, "project_name string, field_path string, field string").join(seen.select("project_name", "field_path", "types"), ["project_name", "field_path"])
    kinds = named.select("field", F.explode_outer("types").alias("t")).groupBy("field").agg(F.collect_set("t").alias("t"))
    kinds = kinds.select("field", F.when(F.size("t") == 1, F.col("t")[0]).otherwise(LATTICE_TOP).alias("type"))
    return named.select("project_name", "field_path", "field").join(kinds, "field").select("project_name", "field_path", "field", "type")


def united_values(files: DataFrame, fields: DataFrame, section: str) -> DataFrame:
    """(file_project, file_seq, file_record, field, type, value): the united table in long form, a row for each value of each record.

    However many fields there are; a record without any value has one row with a null field.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, seq, text in batch.itertuples(index=False, name=None):
                whole = parsed(text)
                for held, i, _, record in sections(whole) if whole is not None else ():
                    if held == section:
                        got = [(project, seq, i, path, plain(value)) for path, value in values(record, section)]
                        out += got or [(project, seq, i, None, None)]
            yield pd.DataFrame(out, columns=["project_name", "file_seq", "file_record", "field_path", "value"])

    rows = present(files).mapInPandas(read, "project_name string, file_seq int, file_record int, field_path string, value string")
    return rows.join(fields, ["project_name", "field_path"], "left").select(F.col("project_name").alias("file_project"), "file_seq", "file_record", "field", "type", "value")


def united_table(files: DataFrame, fields: DataFrame, section: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """One consistent table of a section: a row for each record of each file, a column for each field.

    Keys are file_project, file_seq and file_record (the record's place in the file). Fields
    are those of :func:`united_fields`, named by path without the section and with ``_``
    for dots; a name that is taken already gets a number. A number is DOUBLE, a boolean
    BOOLEAN, any other type STRING as :func:`~metaloom.functions.jsonvalue.plain` writes it.
    A field that a file lacks is null. A schema of more than ``max_columns`` fields is
    refused: :func:`united_values` has them all. Of a file that came twice one copy counts.
    """
    keys = ["file_project", "file_seq", "file_record"]
    here = fields.where(F.substring_index("field", ".", 1) == section).select("field", "type").distinct().orderBy("field").limit(max_columns + 1).collect()
    if len(here) > max_columns:
        raise ValueError(f"more than {max_columns} fields; use united_values")
    rows = united_values(files, fields, section)
    sql, taken, columns = {"number": "double", "boolean": "boolean"}, {k.lower() for k in keys}, []
    for name, what in here:
        short = plain_name = name.split(".", 1)[1].replace(".", "_")
        n = 1
        while short.lower() in taken:
            n += 1
            short = f"{plain_name}_{n}"
        taken.add(short.lower())
        columns.append(F.max(F.when(F.col("field") == name, F.col("value"))).try_cast(sql.get(what, "string")).alias(short))
    return rows.groupBy(*keys).agg(*columns) if columns else rows.select(*keys).distinct()
