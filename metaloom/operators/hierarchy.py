"""Parent-child links to full hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.text import norm_id, norm_ids
from metaloom.session import cut_lineage

#: Groups of at most so many links are peeled in one task; larger ones in rounds over the cluster.
MAX_GROUP_LINKS = 200_000
ON_LOOP, BELOW_LOOP = -1, -2
#: Pairs of ancestor and descendant that are sent on at once.
CHUNK_PAIRS = 500_000


def links(parent_map: DataFrame, child_map: DataFrame) -> DataFrame:
    """(child, grp, parent, grps): each node once, with its parent or null and the projects that name it.

    Of a key's rows in ``parent_map`` the one with the latest recorded_at holds (a null one
    is the earliest; of rows with equal recorded_at that with the largest row_id). Null and
    blank ids name nothing. Should a node have several parents, the smallest counts.
    """
    grp = F.coalesce(F.col("project_name"), F.lit("")).alias("grp")
    nobody = F.lit(None).cast("string")

    def pairs(df: DataFrame, each) -> DataFrame:
        return df.select("grp", F.explode(each).alias("l")).select("grp", "l.child", "l.parent")

    def pair(child, parent):
        return F.struct(child.alias("child"), parent.alias("parent"))

    ups = parent_map.select(grp, norm_id("unique_id").alias("id"), norm_ids("parent_ids").alias("ids"), "recorded_at", "row_id")
    latest = ups.where("id is not null").groupBy("id").agg(F.max(F.struct("recorded_at", "row_id", "ids", "grp")).alias("x")).select("id", "x.ids", "x.grp")
    downs = child_map.select(grp, norm_id("unique_id").alias("id"), norm_ids("child_ids").alias("ids"))
    own = pair(F.col("id"), nobody)
    listed = F.transform("ids", lambda x: pair(x, nobody))
    every = pairs(latest, F.concat(F.array(own), listed, F.transform("ids", lambda p: pair(F.col("id"), p))))
    every = every.unionByName(pairs(downs, F.concat(F.array(own), listed, F.transform("ids", lambda c: pair(c, F.col("id"))))))
    every = every.unionByName(pairs(ups, listed))  # what only outdated rows list is a node too
    return every.where("child is not null").groupBy("child").agg(F.min("grp").alias("grp"), F.min("parent").alias("parent"), F.collect_set("grp").alias("grps"))


def peeling(child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[list[int]]]:
    """(up, size, fronts, loops) of one group of links; every node is once in ``child``, parent is None at a root.

    Leaves are peeled from below, front by front, each sending its subtree's size to its
    parent. What is left has only loops; each goes from a node to its parent, and so on.
    size is that of the node's subtree, not counting the way around a loop.
    """
    index = pd.Index(child)
    up = np.where(pd.isna(parent), -1, index.get_indexer(pd.Series(parent, dtype=object).fillna("")))
    n = len(child)
    waiting = np.bincount(up[up >= 0], minlength=n)
    size, peeled, fronts = np.ones(n, dtype=np.int64), np.zeros(n, dtype=bool), []
    front = np.flatnonzero(waiting == 0)
    while len(front):
        fronts.append(front)
        peeled[front] = True
        above = up[front]
        own = above >= 0
        np.add.at(size, above[own], size[front[own]])
        np.subtract.at(waiting, above[own], 1)
        front = np.unique(above[own])
        front = front[(waiting[front] == 0) & ~peeled[front]]
    loops: list[list[int]] = []
    for start in np.flatnonzero(~peeled):
        if peeled[start]:
            continue
        loop = [start]
        while up[loop[-1]] != start:
            loop.append(up[loop[-1]])
        peeled[loop] = True
        loops.append(loop)
    return up, size, fronts, loops


def peel(child: np.ndarray, parent: np.ndarray, with_line: bool) -> pd.DataFrame:
    """Hierarchy of one group of links (:func:`peeling`).

    In reverse peel order every node takes root, depth and line (see :func:`hierarchies`)
    from its parent.
    """
    up, size, fronts, loops = peeling(child, parent)
    n = len(child)
    depth, root = np.zeros(n, dtype=np.int32), np.arange(n)
    line: list = [None] * n
    for loop in loops:
        least = min(loop, key=lambda i: child[i])
        below = int(size[loop].sum())
        for i in loop:
            depth[i], root[i], size[i] = ON_LOOP, least, below
        if with_line:
            names = [child[i] for i in reversed(loop)]  # from above to below
            for at, i in enumerate(reversed(loop)):
                line[i] = [*names[at + 1 :], *names[: at + 1]]
    for front in reversed(fronts):
        above = up[front]
        own = above >= 0
        low, high = front[own], above[own]
        depth[low] = np.where(depth[high] >= 0, depth[high] + 1, BELOW_LOOP)
        root[low] = root[high]
        if with_line:
            for i in front:
                line[i] = [*line[up[i]], child[i]] if up[i] >= 0 else [child[i]]
    out = pd.DataFrame({"unique_id": child, "root_id": child[root], "depth": depth, "descendants": size - 1})
    if with_line:
        out["line"] = line
    return out


def descend(child: np.ndarray, parent: np.ndarray, chunk: int = CHUNK_PAIRS) -> Iterator[pd.DataFrame]:
    """(ancestor_id, unique_id, distance) of one group of links, in chunks of about ``chunk`` pairs.

    Subtree sizes from the peel give every node, in reverse peel order, its place in one
    list of all nodes in which each subtree is a stretch: a parent reserves a stretch for each
    child. So every node's list of descendants is a slice, whatever its length.
    """
    up, size, fronts, loops = peeling(child, parent)
    n = len(child)
    start, level, ring, place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    taken, spans = 0, []
    for at, loop in enumerate(loops):
        spans.append((taken, taken + int(size[loop].sum()), len(loop)))
        for k, i in enumerate(loop):
            start[i], ring[i], place[i] = taken, at, k
            taken += size[i]
    free = start + 1
    for front in reversed(fronts):
        tops = front[up[front] < 0]
        start[tops] = taken + np.cumsum(size[tops]) - size[tops]
        taken += int(size[tops].sum())
        low = front[up[front] >= 0]
        low = low[np.argsort(up[low], kind="stable")]
        high = up[low]
        before = np.cumsum(size[low]) - size[low]
        first = np.searchsorted(high, high)
        start[low] = free[high] + before - before[first]
        np.add.at(free, high, size[low])
        free[front] = start[front] + 1
        level[low], ring[low], place[low] = level[high] + 1, ring[high], place[high]
    at = np.empty(n, np.int64)
    at[start] = np.arange(n)
    begin, end = start + 1, start + size
    for loop in loops:
        for i in loop:
            begin[i], end[i] = spans[ring[i]][:2]
    many = end - begin
    on = np.zeros(n, bool)
    on[[i for loop in loops for i in loop]] = True
    order, lo = np.flatnonzero(many > 0), 0
    total = np.cumsum(many[order])
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + chunk, side="right")))
        own = order[lo:hi]
        anc = np.repeat(own, many[own])
        pos = np.arange(len(anc)) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + begin[anc]
        for part in range(0, len(anc), chunk):  # one node's own list may be longer than a chunk
            a, d = anc[part : part + chunk], at[pos[part : part + chunk]]
            far = level[d] - np.where(on[a], 0, level[a])
            if loops:
                turn = np.array([s[2] for s in spans])[ring[a]]
                far = far + np.where(on[a], (place[a] - place[d]) % turn, 0)
            keep = a != d
            yield pd.DataFrame({"ancestor_id": child[a[keep]], "unique_id": child[d[keep]], "distance": far[keep].astype(np.int32)})
        lo = hi


def rounds(edges: DataFrame, with_line: bool) -> DataFrame:
    """The same result for groups that are too large for a task, in rounds of joins over the whole cluster.

    Each round joins every open pointer with its target's pointer, so that distances double
    and the tallest tree takes log2(height) rounds. Nodes that no round brings to a root lie
    on or below a loop; doubling goes on until the pointers of these all end on loops. For
    their lines each loop is cut above its smallest id, which makes trees of them.
    """
    ups = F.array("parent") if with_line else F.lit(None).cast("array<string>")
    state = cut_lineage(edges.select(
        F.col("child").alias("node"), F.coalesce("parent", "child").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.least("child", "parent").alias("low"), F.col("parent").isNull().alias("done"), F.when(F.col("parent").isNotNull(), ups).otherwise(F.array().cast("array<string>")).alias("ups"),
    ))
    length, left, spun = 1, state.where(~F.col("done")).count(), 0
    while left and length <= 4 * left + 4:
        a, b = state.alias("a"), state.alias("b")
        step = a.where("not a.done").join(b, F.col("a.anc") == F.col("b.node")).select(
            "a.node", "b.anc", (F.col("a.dist") + F.col("b.dist")).alias("dist"), F.least("a.low", "b.low").alias("low"), "b.done",
            # Only ways to a root become lines, so those of residual nodes need not grow.
            (F.concat("a.ups", "b.ups") if not spun and with_line else F.col("a.ups")).alias("ups"),
        )
        state = cut_lineage(state.where("done").unionByName(step))
        now = state.where(~F.col("done")).count()
        length, spun, left = length * 2, spun or now == left, now
    tree = state.where("done").select(F.col("node").alias("unique_id"), F.col("anc").alias("root_id"), F.col("dist").cast("int").alias("depth"), F.reverse(F.concat(F.array("node"), "ups")).alias("line"))
    rest = state.where("not done")
    ends = rest.select(F.col("anc").alias("at")).distinct()
    loops = rest.join(ends, F.col("node") == F.col("at")).select("at", F.col("low").alias("least"))
    on = loops.select(F.col("at").alias("unique_id"), F.col("least").alias("root_id"), F.lit(ON_LOOP).alias("depth"))
    ends = loops.select(F.col("at").alias("loop_node"))
    below = rest.join(ends, F.col("node") == F.col("loop_node"), "left_anti").join(loops, F.col("anc") == F.col("at")).select(
        F.col("node").alias("unique_id"), F.col("least").alias("root_id"), F.lit(BELOW_LOOP).alias("depth")
    )
    looped = on.unionByName(below)
    if not with_line:
        return tree.drop("line").unionByName(looped)
    if left:
        looped = cut_lineage(looped)
        parent = F.when(F.col("child") != F.col("root_id"), F.col("parent")).alias("parent")
        cut = rounds(edges.join(looped, F.col("child") == F.col("unique_id")).select("child", parent), True).select("unique_id", "line")
        looped = cut_lineage(looped.join(cut, "unique_id"))
        rings = looped.where(F.col("depth") == ON_LOOP).groupBy("root_id").agg(F.max_by("line", F.size("line")).alias("ring"))
        entered = F.size(F.array_intersect("line", "ring"))
        line = F.concat(F.slice("ring", entered + 1, F.size("ring")), "line")
        looped = looped.join(rings, "root_id").select("unique_id", "root_id", "depth", line.alias("line"))
        tree = tree.unionByName(looped)
    sizes = closure(tree).groupBy("ancestor_id").agg(F.count("*").alias("descendants"))
    return tree.join(sizes, F.col("unique_id") == F.col("ancestor_id"), "left").select(*tree.columns, F.coalesce("descendants", F.lit(0)).alias("descendants"))


def grouped(parent_map: DataFrame, child_map: DataFrame, max_group_links: int) -> tuple[DataFrame, DataFrame, bool]:
    """All links, the groups that are too large for a task or share a node with another, and whether there are such."""
    every = cut_lineage(links(parent_map, child_map))
    shared = every.where(F.size("grps") > 1).select(F.explode("grps").alias("grp"))
    large = every.groupBy("grp").count().where(F.col("count") > max_group_links).select("grp").unionByName(shared).distinct()
    return every, large, large.limit(1).count() > 0


def hierarchies(parent_map: DataFrame, child_map: DataFrame, with_path: bool = False, max_group_links: int = MAX_GROUP_LINKS) -> DataFrame:
    """(unique_id, root_id, depth[, path, line, descendants]) of each node, i.e. each id that either table names.

    A node without parent is its own root at depth 0. A node on a loop has depth -1, one that
    hangs below a loop -2; the root of both is the loop's smallest id. path leads from the
    root down to the node; on or below a loop, where no root is above, it is the node alone.
    line has all the node's ancestors, the farthest first, and then the node: its path; on a
    loop once around it from the node's child on the loop; below one the line of the loop node it
    hangs from, and the way down. descendants is the number of nodes whose lines have the
    node above them.

    Method: links are grouped by project, each group is peeled from its leaves and, in
    reverse order, labelled (:func:`peel`). Groups above ``max_group_links``, and groups that
    share a node with another, take :func:`rounds` instead, and no others. Empty tables
    give no rows; nulls, blanks, repeated rows and elements: see :func:`links`.
    """
    every, large, some = grouped(parent_map, child_map, max_group_links)
    fields = "unique_id string, root_id string, depth int" + ", line array<string>, descendants long" * with_path
    keep = [f.split()[0] for f in fields.split(", ")]

    def finish(df: DataFrame) -> DataFrame:
        path = F.when(F.col("depth") >= 0, F.col("line")).otherwise(F.array("unique_id")) if with_path else None
        return df.select(*keep[:3], *([path.alias("path"), *keep[3:]] if with_path else []))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return peel(pdf["child"].to_numpy(object), pdf["parent"].to_numpy(object), with_path)[keep]

    small = every.join(large, "grp", "left_anti") if some else every
    out = small.select("grp", "child", "parent").groupBy("grp").applyInPandas(one, fields)
    return finish(out.unionByName(rounds(every.join(large, "grp", "left_semi"), with_path).select(*keep)) if some else out)


def descendants(parent_map: DataFrame, child_map: DataFrame, max_group_links: int = MAX_GROUP_LINKS) -> DataFrame:
    """(ancestor_id, unique_id, distance): each node with all its descendants.

    The nodes of a loop are each other's descendants, and what hangs below a loop descends
    from all of them; no node is its own. distance is the number of links down. Lists come
    from the peel (:func:`descend`), in chunks; for groups that are too large for a task, or
    share a node with another, from the lines of :func:`rounds` (:func:`closure`).
    """
    every, large, some = grouped(parent_map, child_map, max_group_links)
    fields = "ancestor_id string, unique_id string, distance int"

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts))
        yield from descend(pdf["child"].to_numpy(object), pdf["parent"].to_numpy(object))

    small = every.join(large, "grp", "left_anti") if some else every
    out = small.select("grp", "child", "parent").groupBy("grp").applyInPandas(one, fields)
    return out.unionByName(closure(rounds(every.join(large, "grp", "left_semi"), True))) if some else out


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, unique_id, distance): each node with all its descendants, from the lines of :func:`hierarchies`.

    The nodes of a loop are each other's descendants, and what hangs below a loop descends
    from all of them; no node is its own. distance is the number of links down.
    """
    up = nodes.select("unique_id", F.posexplode("line").alias("pos", "ancestor_id"), F.size("line").alias("n"))
    return up.select("ancestor_id", "unique_id", (F.col("n") - 1 - F.col("pos")).alias("distance")).where("distance > 0")
