"""Lineage, impact and column matching over dependency edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.scores import levenshtein_similarity, types_compatible
from metaloom.functions.text import norm_id, norm_ids
from metaloom.session import cut_lineage


def edges(parent_map: DataFrame) -> DataFrame:
    """(child, parent): every dependency that a row states, once."""
    return parent_map.select(norm_id("unique_id").alias("child"), F.explode(norm_ids("parent_ids")).alias("parent")).where("child is not null").distinct()


#: Graphs of at most so many edges, and bytes of ids, are broadcast and walked within tasks.
MAX_EDGES, MAX_ID_BYTES = 6_000_000, 150_000_000
#: Roots times nodes that a task marks at once.
MARKS = 1 << 22


def small_graph(step: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """The ids in order, where each one's successors begin, and the successors, of edges (at, next); None if there are too many."""
    step = cut_lineage(step.distinct())
    nodes = cut_lineage(step.select(F.col("at").alias("id")).union(step.select("next")).distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("n")))
    size = nodes.agg(F.coalesce(F.sum(F.octet_length("id")), F.lit(0))).first()[0]
    if size > MAX_ID_BYTES or step.count() > MAX_EDGES:
        return None
    ids = nodes.orderBy("n").toArrow().combine_chunks()
    number = ids["n"].to_numpy()
    numbered = step.join(nodes.select(F.col("id").alias("at"), F.col("n").alias("a")), "at").join(nodes.select(F.col("id").alias("next"), F.col("n").alias("b")), "next")
    edges = numbered.select("a", "b").toArrow()
    a, b = (np.searchsorted(number, edges[c].to_numpy()) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    names = ids["id"].combine_chunks()
    return names.cast(pa.string()), np.searchsorted(a[order], np.arange(len(number) + 1)), b[order].astype(np.int32)


def walk(graph: tuple[pa.Array, np.ndarray, np.ndarray], roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, id, depth) as by :func:`reach`: each task walks the graph level by level from its own roots, and nothing is shuffled or kept but these."""
    spark = roots.sparkSession
    shared = spark.sparkContext.broadcast(graph)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, after = shared.value
        n = len(names)
        own = max(1, MARKS // max(1, n))
        met, mark = np.zeros(own * n, bool), np.zeros(own * n, np.int32)
        for batch in batches:
            places = pc.index_in(batch.column(0).cast(pa.string()), names).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(places), own):
                first = places[lo : lo + own]
                row, at, levels = np.arange(len(first)), first, []
                while len(at) and len(levels) < max_depth:
                    many = start[at + 1] - start[at]
                    edge = np.arange(int(many.sum())) + np.repeat(start[at] - (np.cumsum(many) - many), many)
                    key = np.repeat(row * n, many) + after[edge]
                    key = key[~met[key]]
                    # Of a place found several times the last stays.
                    mark[key] = turn = np.arange(len(key), dtype=np.int32)
                    key = key[mark[key] == turn]
                    met[key] = True
                    row, at = key // n, key % n
                    levels.append(key)
                found = np.concatenate(levels) if levels else np.zeros(0, np.int64)
                met[found] = False
                depth = np.repeat(np.arange(1, len(levels) + 1, dtype=np.int32), [len(x) for x in levels])
                for part in range(0, len(found), 100_000):
                    key = found[part : part + 100_000]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(first[key // n])), names.take(pa.array(key % n)), pa.array(depth[part : part + 100_000])], ["root", "id", "depth"])

    tasks = max(spark.sparkContext.defaultParallelism * 4, 12)
    return roots.select("root").distinct().repartition(tasks, "root").mapInArrow(follow, "root string, id string, depth int")


def reach(links: DataFrame, roots: DataFrame, downstream: bool = True, counted: DataFrame | None = None, max_depth: int = 200) -> DataFrame:
    """(root, id, depth): all that each root reaches within ``max_depth``, with the least depth.

    ``counted`` (id) are the nodes that cost a level; all others are passed through at no
    cost, so types left out of a lineage are transparent. Each round joins only what the
    last one improved with the edges, and keeps the least depth per (root, id), so diamonds
    and loops end; the number of rounds is that of hops, and plans are cut between them.
    Roots come out only where they reach themselves. Without ``counted`` a graph of bounded size is
    walked within tasks instead (:func:`walk`), with the same result and nothing on disk; larger ones take the rounds.
    """
    frm, to = ("parent", "child") if downstream else ("child", "parent")
    links = links.where("parent is not null and child is not null")
    if counted is None and (graph := small_graph(links.select(F.col(frm).alias("at"), F.col(to).alias("next")))) is not None:
        return walk(graph, roots, max_depth)
    step = links.select(F.col(frm).alias("at"), F.col(to).alias("next"))
    if counted is None:
        step = step.withColumn("cost", F.lit(1))
    else:
        step = step.join(counted.select(F.col("id").alias("next"), F.lit(1).alias("hit")), "next", "left").select("at", "next", F.coalesce("hit", F.lit(0)).alias("cost"))
    step = cut_lineage(step)
    front = roots.select("root", F.col("root").alias("at"), F.lit(0).alias("depth"))
    best = None
    while True:
        found = front.join(step, "at").select("root", F.col("next").alias("id"), (F.col("depth") + F.col("cost")).alias("depth")).where(F.col("depth") <= max_depth)
        found = found.groupBy("root", "id").agg(F.min("depth").alias("depth"))
        if counted is None:
            # Rounds are levels: what is new now is never improved, so levels are only put together.
            fresh = cut_lineage(found if best is None else found.join(best.select("root", "id"), ["root", "id"], "left_anti"))
            if best is not None and not fresh.limit(1).count():
                return best
            best = fresh if best is None else best.unionByName(fresh)
            front = fresh.select("root", F.col("id").alias("at"), "depth")
            continue
        if best is not None:
            old = best.select("root", "id", F.col("depth").alias("old"))
            found = found.join(old, ["root", "id"], "left").where("old is null or depth < old").drop("old")
        found = cut_lineage(found)
        if not found.limit(1).count():
            return best if best is not None else found
        best = found if best is None else cut_lineage(best.unionByName(found).groupBy("root", "id").agg(F.min("depth").alias("depth")))
        front = found.select("root", F.col("id").alias("at"), "depth")


def lineage_edges(reached: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, parent, child): the edges between what each root reaches, itself included."""
    nodes = reached.select("root", "id").unionByName(roots.select("root", F.col("root").alias("id"))).distinct()
    met = links.join(nodes.select("root", F.col("id").alias("child")), "child")
    return met.join(nodes.select("root", F.col("id").alias("parent")), ["root", "parent"], "left_semi").select("root", "parent", "child")


def impact(reached: DataFrame, entities: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(root, resource_type, entities, score): what is downstream of each root by type, and the root's impact score.

    The score is the number of all known dependents; with ``columns`` (unique_id, column_name)
    times the number of columns that the root declares.
    """
    typed = reached.join(entities.select(F.col("unique_id").alias("id"), "resource_type"), "id")
    by_type = typed.groupBy("root", "resource_type").agg(F.count("*").alias("entities"))
    total = by_type.groupBy("root").agg(F.sum("entities").alias("score"))
    if columns is not None:
        own = columns.groupBy(F.col("unique_id").alias("root")).agg(F.countDistinct("column_name").alias("c"))
        total = total.join(own, "root", "left").select("root", (F.col("score") * F.coalesce("c", F.lit(0))).alias("score"))
    return by_type.join(total, "root")


def orphans(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities that no edge touches."""
    touched = links.select(F.col("child").alias("unique_id")).unionByName(links.select(F.col("parent").alias("unique_id"))).distinct()
    return entities.join(touched, "unique_id", "left_anti").select("unique_id", "resource_type")


def on_cycles(links: DataFrame) -> DataFrame:
    """(child, parent): the edges left when nodes without parents or without children are taken away again and again.

    What is left is empty if and only if there is no cycle; otherwise it holds all cycles and the ways between them.
    """
    left = cut_lineage(links.distinct())
    n = left.count()
    while n:
        keep = left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        keep = keep.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        keep = cut_lineage(keep.select("child", "parent"))
        now = keep.count()
        if now == n:
            break
        left, n = keep, now
    return left


#: Each way in which a column continues another: the strategy's weight, its strength, its confidence.
STRATEGIES = {
    "exact_match": (1.0, 1.0, "high"), "sql_alias": (0.9, 0.9, "medium"), "source_match": (0.8, 0.8, "medium"), "nested_match": (0.5, 0.6, "low"), "suffix_match": (0.4, 0.6, "low"), "prefix_match": (0.4, 0.6, "low"),
    "normalized_match": (0.5, 0.55, "low"), "levenshtein_match": (0.6, None, "low"), "proximity_match": (0.3, 0.5, "low"),
}


def column_matches(pairs: DataFrame) -> DataFrame:
    """(…keys, source_column, target_column, match_type, confidence, score): the best way in which a target column continues the source column.

    ``pairs`` has source_column, target_column, source_type, target_type and ``alias``, whether the
    SQL between them renames one to the other; optionally ``from_source``, whether the source
    column's entity is a source, and source_place and target_place, the columns' places in their
    entities. Pairs come from the columns of entities that an edge links, never from all
    entities. Scores are a strategy's weight times its strength; a match needs compatible types.
    Strategies: equal names; a rename in SQL; equal names but for a source's prefix of letters and ``_``; a
    field of a nested name (``a.b`` or ``a__b``); one name ends or begins with the other; equal
    letters and digits; three quarters alike; the same place, where half of the names' words agree.
    """
    a, b = F.lower("source_column"), F.lower("target_column")
    na, nb = F.regexp_replace(a, r"[^\p{L}\p{N}]", ""), F.regexp_replace(b, r"[^\p{L}\p{N}]", "")
    similar = levenshtein_similarity(a, b)
    long2 = (F.octet_length(a) >= 2) & (F.octet_length(b) >= 2)
    no = F.lit(False)
    from_source = F.col("from_source") if "from_source" in pairs.columns else no
    near = F.abs(F.col("source_place") - F.col("target_place")) <= 1 if "source_place" in pairs.columns else no
    wa, wb = F.split(a, "[_.]+"), F.split(b, "[_.]+")
    agree = F.size(F.array_intersect(wa, wb)) * 2 >= F.greatest(F.size(wa), F.size(wb))
    last_a, last_b = F.element_at(F.split(a, r"\.|__"), -1), F.element_at(F.split(b, r"\.|__"), -1)
    when = {
        "exact_match": a == b, "sql_alias": F.col("alias"), "source_match": from_source & (F.regexp_replace(a, "^[a-z]+_", "") == b) & (a != b),
        "nested_match": (a != b) & (last_a == last_b) & (F.octet_length(last_a) >= 3) & (F.instr(F.concat(a, b), ".") + F.instr(F.concat(a, b), "__") > 0),
        "suffix_match": long2 & (b.endswith(a) | a.endswith(b)), "prefix_match": long2 & (b.startswith(a) | a.startswith(b)), "normalized_match": (na != "") & (na == nb),
        "levenshtein_match": (F.octet_length(a) >= 3) & (F.octet_length(b) >= 3) & (similar >= 0.75), "proximity_match": near & agree,
    }
    options = []
    for name, (weight, strength, confidence) in STRATEGIES.items():
        score = F.lit(weight) * (similar if strength is None else F.lit(strength))
        options.append(F.when(F.coalesce(when[name], no), F.struct(score.alias("score"), F.lit(name).alias("match_type"), F.lit(confidence).alias("confidence"))))
    ok = types_compatible(F.col("source_type"), F.col("target_type"))
    best = F.array_max(F.array_compact(F.array(*options)))
    drop = ("alias", "from_source", "source_place", "target_place")
    return pairs.where(ok).withColumn("best", best).where("best is not null").select(*[c for c in pairs.columns if c not in drop], "best.match_type", "best.confidence", F.round("best.score", 6).alias("score"))


def column_pairs(links: DataFrame, columns: DataFrame, aliases: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The pairs of columns along all edges, for :func:`column_matches`.

    ``columns`` has unique_id, column_name and data_type, optionally place; ``aliases``
    unique_id, column_name and alias, from the entity's SQL
    (:func:`~metaloom.sql.structure.alias_pairs`); ``sources`` unique_id of entities that are sources.
    """
    more = ["place"] if "place" in columns.columns else []
    left = columns.select(F.col("unique_id").alias("parent"), F.col("column_name").alias("source_column"), F.col("data_type").alias("source_type"), *[F.col(c).alias("source_place") for c in more])
    right = columns.select(F.col("unique_id").alias("child"), F.col("column_name").alias("target_column"), F.col("data_type").alias("target_type"), *[F.col(c).alias("target_place") for c in more])
    pairs = links.join(left, "parent").join(right, "child")
    if sources is not None:
        pairs = pairs.join(sources.select(F.col("unique_id").alias("parent"), F.lit(True).alias("s")).distinct(), "parent", "left").withColumn("from_source", F.coalesce("s", F.lit(False))).drop("s")
    if aliases is None:
        return pairs.withColumn("alias", F.lit(False))
    a = aliases.select(F.col("unique_id").alias("child"), F.lower("column_name").alias("x"), F.lower("alias").alias("y"), F.lit(True).alias("hit")).distinct()
    keyed = pairs.withColumn("x", F.lower("source_column")).withColumn("y", F.lower("target_column")).join(a, ["child", "x", "y"], "left")
    return keyed.withColumn("alias", F.coalesce("hit", F.lit(False))).drop("x", "y", "hit")


#: Confidences in order.
CONFIDENCE = ("low", "medium", "high")


def column_lineage(matches: DataFrame, roots: DataFrame, downstream: bool = True, least: str = "low", max_depth: int = 10) -> DataFrame:
    """(root, root_column, unique_id, column_name, depth, confidence, score): what each column becomes, hop by hop.

    ``matches`` are those of :func:`column_matches` along all edges, with parent and child; ``roots``
    has root and root_column. Only matches of at least the confidence are followed. A
    column is taken at its least depth; its score is the best product of the scores on a way of that depth,
    its confidence the lowest on that way. Order of results: depth, score, then names.
    """
    rank = F.lit(0)
    for i, name in enumerate(CONFIDENCE):
        rank = F.when(F.col("confidence") == name, i).otherwise(rank)
    keep = matches.withColumn("c", rank).where(F.col("c") >= CONFIDENCE.index(least))
    up, down = ("parent", "source_column"), ("child", "target_column")
    frm, to = (up, down) if downstream else (down, up)
    step = cut_lineage(keep.select(F.col(frm[0]).alias("at"), F.lower(frm[1]).alias("at_column"), F.col(to[0]).alias("unique_id"), F.lower(to[1]).alias("column_name"), "c", F.col("score").alias("s")))
    front = roots.select("root", F.lower("root_column").alias("root_column"), F.col("root").alias("at"), F.lower("root_column").alias("at_column"), F.lit(1.0).alias("score"), F.lit(len(CONFIDENCE) - 1).alias("c0"))
    best, key = None, ["root", "root_column", "unique_id", "column_name"]
    for depth in range(1, max_depth + 1):
        met = front.join(step, ["at", "at_column"]).where(~((F.col("unique_id") == F.col("root")) & (F.col("column_name") == F.col("root_column"))))
        found = met.groupBy(*key).agg(F.max(F.struct((F.col("score") * F.col("s")).alias("score"), F.least("c0", "c").alias("c"))).alias("x")).select(*key, F.lit(depth).alias("depth"), "x.score", "x.c")
        found = cut_lineage(found if best is None else found.join(best.select(*key), key, "left_anti"))
        if not found.limit(1).count():
            break
        best = found if best is None else best.unionByName(found)
        front = found.select("root", "root_column", F.col("unique_id").alias("at"), F.col("column_name").alias("at_column"), "score", F.col("c").alias("c0"))
    out = best if best is not None else found
    name = F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), F.col("c") + 1)
    return out.select(*key, "depth", name.alias("confidence"), F.round("score", 6).alias("score"))


def column_references(texts: DataFrame, column: str) -> DataFrame:
    """(doc_id, times): how often a text names the column as a whole identifier, in any case."""
    found = F.size(F.regexp_extract_all("text", F.lit(rf"(?i)(?<![\w])({re.escape(column)})(?![\w])"), 1))
    return texts.select("doc_id", found.alias("times")).where("times > 0")
