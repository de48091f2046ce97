"""Most similar vectors for every vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.session import cut_lineage

#: Vectors of a cell, i.e. of one task's index; of a list within a cell.
CELL_ROWS, LIST_ROWS = 8_000, 160
#: Lists that a query probes in each cell it visits.
PROBES = 8
#: A query visits each cell whose centroid is at most so much less similar than the nearest.
MARGIN = 0.06
#: More cells than this are routed on two levels: groups of cells first, whose centroids may be so much less similar.
FLAT_CELLS, GROUP_MARGIN = 64, 0.25
#: A cell of more than twice its rows, by the sample, is split by its vectors; one of more than four times as many queries by these.
HOME_TIMES, QUERY_TIMES = 2, 4
#: A cell with less than this share of the mean is given up.
SMALL = 0.2
#: Queries of one block of the exact search.
EXACT_QUERIES = 20_000
#: The index is fitted on at most this many vectors per centroid, and of all; every vector is indexed.
FIT_PER_CELL, FIT_ROWS = 60, 200_000
#: Width of the column blocks of the adaptive scan, and its confidence: larger abandons later.
BLOCK, EPSILON = 16, 2.1
SEED = 7


def unit(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which rows are usable: finite and not all zero."""
    x = flat.reshape(-1, dim).astype(np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(x).all(axis=1) & (top > 0)
        x = x / np.where(good, top, 1)[:, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
    return x[good].astype(np.float32), good


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; an empty cluster starts again at a vector of the sample."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        lost = size < 1e-6
        total[lost] = x[rng.choice(len(x), int(lost.sum()))]
        c = total / np.linalg.norm(total, axis=1, keepdims=True)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


@dataclass
class Router:
    """Centroids of a model's cells, in groups of near cells, and the parts that each cell is split into."""

    groups: np.ndarray | None
    #: Cells of each group, as positions in ``cells``.
    members: list[np.ndarray]
    cells: np.ndarray
    home_parts: np.ndarray
    query_parts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int, flat: int = FLAT_CELLS) -> Router:
        """k cells; with more than ``flat`` of them about sqrt(k) groups are fitted first and each is cut on its own."""
        one = np.ones(k, np.int64)
        if k <= flat:
            return cls(None, [np.arange(k)], centroids(x, k), one, one)
        groups = centroids(x, int(np.sqrt(k)))
        at = nearest(x, groups)
        share = np.bincount(at, minlength=len(groups)) * (k / len(x))
        cells, members, held = [], [], np.flatnonzero(share > 0)
        for g in held:
            own = x[at == g]
            n = min(len(own), max(1, round(share[g])))
            members.append(np.arange(n) + sum(map(len, cells)))
            cells.append(centroids(own, n))
        groups = groups[held]
        cells = np.concatenate(cells)
        one = np.ones(len(cells), np.int64)
        return cls(groups, members, cells, one, one)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) of each visit, and each row's nearest cell."""
        if self.groups is None:
            sim = x @ self.cells.T
            near = sim.argmax(axis=1)
            row, cell = np.nonzero(sim >= sim[np.arange(len(x)), near][:, None] - MARGIN)
            return row, cell, near
        coarse = x @ self.groups.T
        enter = coarse >= coarse.max(axis=1, keepdims=True) - GROUP_MARGIN
        best, near, seen = np.full(len(x), -np.inf, np.float32), np.zeros(len(x), np.int64), []
        for g, cells in enumerate(self.members):
            rows = np.flatnonzero(enter[:, g])
            if not len(rows):
                continue
            sim = x[rows] @ self.cells[cells].T
            top = sim.argmax(axis=1)
            value = sim[np.arange(len(rows)), top]
            more = value > best[rows]
            best[rows[more]], near[rows[more]] = value[more], cells[top[more]]
            i, j = np.nonzero(sim >= value[:, None] - MARGIN)
            seen.append((rows[i], cells[j], sim[i, j]))
        row, cell, sim = (np.concatenate([s[i] for s in seen]) for i in range(3))
        keep = sim >= best[row] - MARGIN
        return row[keep], cell[keep], near

    def without_small_cells(self, x: np.ndarray) -> Router:
        """The router without cells of less than SMALL of the mean, whose few vectors would find no others at home."""
        _, _, near = self.visits(x)
        load = np.bincount(near, minlength=len(self.cells))
        keep = load >= min(SMALL * load.mean(), load.max())
        new, one = np.cumsum(keep) - 1, np.ones(keep.sum(), np.int64)
        members = [new[m[keep[m]]] for m in self.members]
        groups = None if self.groups is None else self.groups[[len(m) > 0 for m in members]]
        return Router(groups, [m for m in members if len(m)], self.cells[keep], one, one)

    def split(self, sample: np.ndarray, times: float, cell_rows: int) -> None:
        """Parts of cells that would hold too much, each vector of the sample standing for ``times``."""
        _, cell, near = self.visits(sample)
        home = np.bincount(near, minlength=len(self.cells)) * times
        query = np.bincount(cell, minlength=len(self.cells)) * times
        self.home_parts = np.maximum(1, np.ceil(home / (HOME_TIMES * cell_rows))).astype(np.int64)
        self.query_parts = np.maximum(1, np.ceil(query / (QUERY_TIMES * cell_rows))).astype(np.int64)

    def route(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, part, home, query): each vector as a query in one query part of every home part it visits, and
        at home in every query part of its home part. part numbers the grid of both."""
        row, cell, near = self.visits(x)
        out = []
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        pick = ((mixed ^ (mixed >> np.uint64(31))) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        hp, qp = self.home_parts[cell], self.query_parts[cell]
        which = np.arange(hp.sum()) - np.repeat(np.cumsum(hp) - hp, hp)
        r, c, q = np.repeat(row, hp), np.repeat(cell, hp), np.repeat(qp, hp)
        mine = (c == near[r]) & (which == pick[r] % np.repeat(hp, hp))
        turn = (pick[r] // 7919) % q
        out.append((r, c, which * q + turn, mine, np.ones(len(r), bool)))
        # At home in the other query parts.
        rows = np.flatnonzero(self.query_parts[near] > 1)
        c = near[rows]
        q, at = self.query_parts[c], pick[rows] % self.home_parts[c]
        part = np.arange(q.sum()) - np.repeat(np.cumsum(q) - q, q)
        r, c, at, q = np.repeat(rows, q), np.repeat(c, q), np.repeat(at, q), np.repeat(q, q)
        other = part != (pick[r] // 7919) % q
        out.append((r[other], c[other], (at * q + part)[other], np.ones(other.sum(), bool), np.zeros(other.sum(), bool)))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Best:
    """The k best (id, similarity) of each query so far; of equal similarities the smaller id."""

    def __init__(self, n: int, k: int, kind: type = np.float32):
        self.k, self.sim, self.who = k, np.full((n, k), -np.inf, kind), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, who: np.ndarray, sim: np.ndarray) -> None:
        """Candidates as parallel arrays; a query may come several times, a candidate once."""
        if not len(q):
            return
        rows, at = np.unique(q, return_inverse=True)
        allq = np.concatenate([at, np.repeat(np.arange(len(rows)), self.k)])
        alls, allw = np.concatenate([sim, self.sim[rows].ravel()]), np.concatenate([who, self.who[rows].ravel()])
        order = np.lexsort((allw, -alls, allq))
        first = np.searchsorted(allq[order], np.arange(len(rows)))
        take = order[first[:, None] + np.arange(self.k)]
        self.sim[rows], self.who[rows] = alls[take], allw[take]


def scan(best: Best, q: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, ids: np.ndarray) -> None:
    """Offer one list's items to the queries ``q`` that probe it, with the adaptive dimension scan.

    Both sides are rotated, so that the first columns are a random projection. After each
    column block the partial squared distance, scaled to all dimensions, is tested against
    the query's k-th best so far; a candidate that is farther with the test's confidence is
    abandoned, so that few reach the last block.
    """
    dim = items.shape[1]
    for lo in range(0, len(q), 1024):
        rows = q[lo : lo + 1024]
        x = queries[rows]
        limit = 2 - 2 * best.sim[rows, -1]  # squared distance; infinite while there are less than k
        fresh = ~np.isfinite(limit)
        if fresh.any():
            at = np.flatnonzero(fresh)
            sim = x[at] @ items.T
            sim[query_ids[rows[at]][:, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-sim, min(best.k, len(ids) - 1), axis=1)[:, : best.k] if len(ids) > best.k else np.broadcast_to(np.arange(len(ids)), sim.shape)
            cut = np.take_along_axis(sim, top, 1).min(axis=1)
            i, j = np.nonzero((sim >= cut[:, None]) & np.isfinite(sim))
            best.add(rows[at][i], ids[j], sim[i, j])
        at = np.flatnonzero(~fresh)
        if not len(at):
            continue
        part = 2 * (x[at, :BLOCK] @ items[:, :BLOCK].T)
        part = (x[at, :BLOCK] ** 2).sum(1)[:, None] + (items[:, :BLOCK] ** 2).sum(1)[None, :] - part
        d = BLOCK
        i, j = np.nonzero(part <= (limit[at] * (d / dim) * (1 + EPSILON / np.sqrt(d)) ** 2)[:, None])
        dist = part[i, j]
        while d < dim and len(i):
            a, b = x[at[i], d : d + BLOCK], items[j, d : d + BLOCK]
            dist = dist + ((a - b) ** 2).sum(1)
            d = min(dim, d + BLOCK)
            factor = (d / dim) * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-5
            keep = dist <= limit[at[i]] * factor + 1e-6
            i, j, dist = i[keep], j[keep], dist[keep]
        other = query_ids[rows[at[i]]] != ids[j]
        i, j = i[other], j[other]
        best.add(rows[at[i]], ids[j], np.einsum("ij,ij->i", x[at[i]], items[j]))


def search_cell(ids: np.ndarray, x: np.ndarray, home: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, Best]:
    """The k best of the cell's own vectors (``home``) for each of its queries, by id."""
    ids, first = np.unique(ids, return_index=True)
    x, home, asks = x[first] @ rotation(x.shape[1]), home[first], np.flatnonzero(query[first])
    best, own = Best(len(ids), k), np.flatnonzero(home)
    if not len(own):
        return ids, best
    lists = max(1, round(len(own) / LIST_ROWS))
    rng = np.random.default_rng(SEED)
    fit = x[rng.choice(own, min(len(own), lists * FIT_PER_CELL), replace=False)]
    c = centroids(fit, lists)
    at = nearest(x[own], c)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(lists + 1))
    probes = min(PROBES, lists)
    near = np.concatenate([np.argsort(-(x[asks[i : i + 4096]] @ c.T), axis=1)[:, :probes] for i in range(0, len(asks), 4096)] or [np.zeros((0, probes), np.int64)])
    for step in range(probes):
        order_ = np.argsort(near[:, step], kind="stable")
        edge = np.searchsorted(near[order_, step], np.arange(lists + 1))
        group = asks[order_]
        for j in range(lists):
            mine = own[order[ends[j] : ends[j + 1]]]
            if len(mine) and edge[j] < edge[j + 1]:
                scan(best, group[edge[j] : edge[j + 1]], x, ids, x[mine], ids[mine])
    return ids, best


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(model_name, vec_id, v) of the rows with an id and a vector of the right length, finite and not all zero."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    return vectors.select(F.coalesce("model_name", F.lit("")).alias("model_name"), F.col("vec_id").cast("long").alias("vec_id"), F.col("dense_embedding").cast("array<float>").alias("v")).where(
        (F.size("v") == dim) & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )


def spare_copies(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows to search, and the neighbours of those that need no search.

    Of more than k + 1 exact copies all but the k + 1 smallest ids have just the k smallest
    as their neighbours, so a hot group of copies never reaches one task. Groups are counted
    by two hashes before any shuffle; only their k + 1 smallest ids are kept of each.
    """
    key = ["model_name", "h"]
    rows = rows.withColumn("h", F.struct(F.xxhash64("v"), F.xxhash64("v", F.lit(1))))
    hot = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select(*key))
    if not hot.limit(1).count():
        return rows.drop("h"), None
    ids = rows.select(*key, "vec_id").join(hot, key, "left_semi").groupBy(*key, "vec_id").agg(F.lit(1).alias("one"))
    least = ids.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    heads = cut_lineage(least.groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    tagged = rows.join(heads, key, "left")
    spare = tagged.where(~F.array_contains("ids", F.col("vec_id"))).select("vec_id", F.explode(F.slice("ids", 1, k)).alias("other")).distinct()
    kept = tagged.where(F.col("ids").isNull() | F.array_contains("ids", F.col("vec_id"))).select("model_name", "vec_id", "v")
    return kept, spare.select("vec_id", "other", F.lit(1.0).cast("float").alias("similarity"))


def neighbours(vectors: DataFrame, k: int = 5, dim: int = 64, cell_rows: int = CELL_ROWS, flat_cells: int = FLAT_CELLS) -> DataFrame:
    """(vec_id, other, similarity): for each usable vector the k most similar of the same model_name.

    ``vectors`` has vec_id, model_name and dense_embedding. Similarity is the cosine; a
    vector is usable if it has ``dim`` finite values that are not all zero, others are
    ignored. A null model_name counts as an empty one. Repeated rows (same vec_id) count
    once; of equal similarities the smaller vec_id is taken; a model with less than k + 1
    vectors gives fewer neighbours. Further columns are ignored.

    Method: an inverted index of two levels, searched by an adaptive dimension scan. Cells
    are fitted on a bounded sample (FIT_PER_CELL vectors a cell, FIT_ROWS at most); every
    vector is stored in its nearest cell and, as a query, visits also the cells that are
    nearly as near (MARGIN); many cells are found through groups of cells (:class:`Router`).
    A cell is one task: it makes lists of about LIST_ROWS vectors and
    scans, for each query, PROBES of these in column blocks of rotated dimensions, where
    hypothesis tests abandon most candidates after the first block (:func:`scan`). A cell
    that, by the sample, would hold far more than ``cell_rows`` vectors, or see far more
    queries, is split at random into a grid of parts by both, each a task. The result is
    approximate: a neighbour in a list that isn't probed is missed. :func:`recall` measures it.
    """
    spark = vectors.sparkSession
    rows, spare = spare_copies(usable(vectors, dim), k)
    sizes = {r[0]: r[1] for r in rows.groupBy("model_name").count().where(F.col("count") > cell_rows).collect()}  # at most rows / cell_rows names
    index: dict[str, Router] = {}
    total = sum(sizes.values())
    if sizes:
        cells = {m: -(-n // cell_rows) for m, n in sizes.items()}
        want = min(FIT_ROWS, FIT_PER_CELL * sum(cells.values()) + 1000)
        mod = 1_000_003
        part = rows.where(F.col("model_name").isin(list(sizes))).where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(mod)) < int(mod * min(1.0, 1.1 * want / total)) + 1)
        found = part.select("model_name", "v").limit(2 * FIT_ROWS).toArrow()
        names = np.asarray(found["model_name"].to_pylist(), dtype=object)
        flat = found["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, good = unit(flat, dim)
        names = names[good]
        for m, n in cells.items():
            own = x[names == m]
            if len(own) < 2:
                continue
            index[m] = Router.fit(own, min(n, len(own)), flat_cells).without_small_cells(own)
            index[m].split(own, sizes[m] / len(own), cell_rows)
    shared = spark.sparkContext.broadcast(index)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False), dim)
            names = np.asarray(batch.column(0).to_pylist(), dtype=object)[good]
            ids = batch.column(1).to_numpy(zero_copy_only=False)[good]
            out: list[tuple] = []
            for m in set(names):
                at = np.flatnonzero(names == m)
                if m not in shared.value:
                    zero, yes = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                    out.append((m, at, zero, zero, yes, yes))
                    continue
                i, *rest = shared.value[m].route(x[at], ids[at])
                out.append((m, at[i], *rest))
            for m, i, cell, which, home, query in out:
                held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(i), [None, pa.py_buffer(np.ascontiguousarray(x[i]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(i), pa.string()), pa.array(cell.astype(np.int32)), pa.array(which.astype(np.int32)), pa.array(home), pa.array(query), pa.array(ids[i]), held], names=["model_name", "cell", "part", "home", "query", "vec_id", "v"])

    def search(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group["v"].to_pylist()), np.float32).reshape(-1, dim)
        ids, best = search_cell(group["vec_id"].to_numpy(), x, group["home"].to_numpy(zero_copy_only=False), group["query"].to_numpy(zero_copy_only=False), k)
        some = np.isfinite(best.sim)
        ends = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32))
        return pa.table({"vec_id": ids, "others": pa.ListArray.from_arrays(ends, pa.array(best.who[some])), "sims": pa.ListArray.from_arrays(ends, pa.array(best.sim[some]))})

    routed = rows.select("model_name", "vec_id", "v").mapInArrow(route, "model_name string, cell int, part int, home boolean, query boolean, vec_id long, v binary")
    partial = routed.groupBy("model_name", "cell", "part").applyInArrow(search, "vec_id long, others array<long>, sims array<float>")
    met = partial.select("vec_id", F.zip_with("sims", "others", lambda s, o: F.struct((-s).alias("far"), o.alias("other"))).alias("x"))
    merged = met.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))), 1, k).alias("x"))
    out = merged.select("vec_id", F.explode("x").alias("x")).select("vec_id", "x.other", (-F.col("x.far")).alias("similarity"))
    return out.unionByName(spare) if spare is not None else out


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: each pair in which one is among the other's neighbours."""
    return found.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()


def exact_neighbours(vectors: DataFrame, k: int = 5, dim: int = 64, every: int = 50, block: int = EXACT_QUERIES) -> DataFrame:
    """(model_name, vec_id, other, similarity): the k most similar of all vectors, for each usable one whose id ``every`` divides.

    Brute force over the stated query set: queries are broadcast in blocks of at most ``block``
    (5 MB at 64 values), each against all rows; a task keeps the k best of each query.
    Similarities are compared to nine decimals, of equal ones the smaller id is taken.
    Null, repeated and unusable rows are treated as by :func:`neighbours`.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim).dropDuplicates(["vec_id"])
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    partial = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((own["model_name"].to_pylist(), own["vec_id"].to_numpy(), own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, ids, flat = shared.value
            q = flat.reshape(-1, dim).astype(np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True) if len(q) else 1
            names = np.asarray(names, dtype=object)
            best = {m: Best(int((names == m).sum()), k, np.float64) for m in set(names)}
            for batch in batches:
                models = np.asarray(batch.column(0).to_pylist(), dtype=object)
                who = batch.column(1).to_numpy(zero_copy_only=False)
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True) if len(x) else 1
                for m in best:
                    asks, mine = np.flatnonzero(names == m), np.flatnonzero(models == m)
                    for lo in range(0, len(mine), 2048):
                        part = mine[lo : lo + 2048]
                        sim = np.round(q[asks] @ x[part].T, 9)
                        sim[ids[asks][:, None] == who[part][None, :]] = -np.inf
                        floor = np.maximum(best[m].sim[:, -1], np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else -np.inf)
                        i, j = np.nonzero((sim >= floor[:, None]) & np.isfinite(sim))
                        best[m].add(i, who[part[j]], sim[i, j])
            for m, found in best.items():
                i, j = np.nonzero(np.isfinite(found.sim))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(i), pa.string()), pa.array(ids[names == m][i]), pa.array(found.who[i, j]), pa.array(found.sim[i, j])], names=["model_name", "vec_id", "other", "similarity"])

        part = rows.select("model_name", "vec_id", "v").mapInArrow(search, "model_name string, vec_id long, other long, similarity double")
        partial = part if partial is None else partial.unionByName(part)
    order = W.partitionBy("model_name", "vec_id").orderBy(F.desc("similarity"), "other")
    return partial.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(model_name, queries, recall): the share of the exact neighbours that were found, or are equalled by a found one."""
    worst = exact.groupBy("model_name", "vec_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    met = worst.join(found.select("vec_id", F.col("similarity").alias("s")), "vec_id", "left")
    each = met.groupBy("model_name", "vec_id", "n").agg(F.count(F.when(F.col("s") >= F.col("least") - 1e-6, 1)).alias("hits"))
    return each.groupBy("model_name").agg(F.count("*").alias("queries"), (F.sum(F.least("hits", "n")) / F.sum("n")).alias("recall"))
