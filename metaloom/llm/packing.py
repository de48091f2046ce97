"""Filling containers of fixed capacity with items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.llm.tokens import VOCABULARY, token_counts
from metaloom.plans.skew import hot_keys, with_parts
from metaloom.session import cut_lineage

#: Length buckets of a capacity, and the least share of all tokens that each holds.
BUCKETS, LEAST_SHARE = 4, 0.02
#: Columns of the table of all pairs of bounds that are held at once: memory is so many times the number of sizes.
COLUMNS = 256


def least_containers(sizes: np.ndarray, counts: np.ndarray, capacity: int, ends: np.ndarray, columns: slice = slice(None)) -> np.ndarray:
    """For each pair i < j of ``ends``: how many containers the items of sizes in (ends[i], ends[j]] need at least. ``columns``: of these j only.

    Items above half the capacity meet no other such item, items above capacity - t none of
    size t or more, and at most k items above capacity / (k + 1) share a container. What
    a batch of the bucket leaves unused is these containers' room less the items' tokens.

    All limits t are tried, at the cost of one: below i + 1 the least t is never better than i + 1 itself, up to
    capacity - j only the items from t to half depend on t, and above it the best is a
    running maximum from the right.
    """
    many = np.concatenate([[0], np.cumsum(np.bincount(sizes, weights=counts, minlength=capacity + 1))])
    total = np.concatenate([[0], np.cumsum(np.bincount(sizes, weights=counts * sizes, minlength=capacity + 1))])
    low, high = ends[:, None], ends[columns][None, :]

    def between(sums: np.ndarray, a: int, b: int) -> np.ndarray:
        a, b = np.clip(a, low, high), np.clip(b, low, high)
        return np.where(b > a, sums[b + 1] - sums[np.minimum(a, b) + 1], 0.0)

    half = capacity // 2
    # Tokens of sizes from t to half, and the room that items above half, up to a size, leave.
    small = total[half + 1] - total[: half + 2]
    room = (many[1:] - many[half + 1]) * capacity - (total[1:] - total[half + 1])
    # over[t]: the most by which, for any limit from t to half, small items exceed what the large ones of up to capacity - t leave.
    t = np.arange(half + 1)
    over = np.append(np.maximum.accumulate((small[: half + 1] - room[capacity - t])[::-1])[::-1], -np.inf)
    first = np.minimum(low + 1, half + 1)
    past = np.clip(np.maximum(first, capacity - high + 1), 0, half + 1)
    rest = np.where(first <= np.minimum(capacity - high, half), small[first] - room[high], -np.inf)
    rest = np.where(high > half, np.maximum(rest, over[past]), total[high + 1] - total[np.minimum(low, high) + 1])
    need = between(many, half, capacity) + np.maximum(rest, 0) / capacity
    for k in range(2, 12):
        need = np.maximum(need, between(many, capacity // (k + 1), capacity) / k)
    return np.ceil(need - 1e-9)


def best_buckets(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS, least_share: float = LEAST_SHARE) -> np.ndarray:
    """Upper bounds of the ``buckets`` length buckets with the least padding, each with at least a share of the tokens.

    Padding is what a bucket's batches lack to their capacity (:func:`least_containers`).
    Dynamic programming over the histogram: the best end of b buckets at a size is the best of
    all ends of b - 1 buckets before it, and one bucket between. Every size may be a bound, so
    the time grows with the square of the number of sizes, of which there are at most ``capacity``. With fewer sizes than
    buckets, or too little apart, there are as many buckets as possible.
    """
    order = np.argsort(sizes)
    sizes, counts = np.asarray(sizes)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    if not len(sizes):
        return sizes
    ends, held = np.concatenate([[0], sizes]), np.concatenate([[0], np.cumsum(counts * sizes)])
    # Row b: the least cost of b buckets that end at a size, and where the last of them begins.
    n = min(buckets, len(sizes))
    best, cut = np.full((n + 1, len(ends)), np.inf), np.zeros((n + 1, len(ends)), np.int64)
    best[0, 0] = 0
    for lo in range(0, len(ends), COLUMNS):
        own = slice(lo, lo + COLUMNS)
        before = slice(0, min(lo + COLUMNS, len(ends)))
        step = held[None, own] - held[before, None]
        cost = np.where((ends[None, own] > ends[before, None]) & (step >= least_share * held[-1]), least_containers(sizes, counts, capacity, ends[before], own), np.inf)
        for b in range(1, n + 1):
            # Ends of b - 1 buckets in the same columns are known by now.
            whole = best[b - 1, before, None] + cost
            cut[b, own] = whole.argmin(axis=0)
            best[b, own] = whole.min(axis=0)
    cuts = []
    for b in range(1, n + 1):
        if not np.isfinite(best[b, -1]):
            break
        cuts.append(cut[b])
    out, at = [], len(ends) - 1
    for cut in reversed(cuts):
        out.append(ends[at])
        at = cut[at]
    return np.array(out[::-1], np.int64)


@dataclass
class Plan:
    """Which place of a container each item of a size takes.

    Items of one size are interchangeable: the one of rank r among its size's takes, of the
    runs of that size, the run whose ranks hold r.
    """

    bounds: np.ndarray
    #: For each run: size, first rank, items a container, first container.
    runs: np.ndarray
    containers: int
    #: For each pattern: first container, bucket's bound.
    patterns: np.ndarray


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS, fill_gaps: bool = False, bounds: np.ndarray | None = None) -> Plan:
    """Containers for a histogram of sizes up to ``capacity``; ``bounds`` overrides the buckets that are best.

    Buckets are worked from the longest. A batch takes items of its bucket, longest first,
    while the token budget lasts, and nothing else. Only with ``fill_gaps`` what is left of the
    budget goes to the longest items of shorter buckets that fit. Equal batches are made
    together, as many as the counts allow, so the work depends on the number of sizes, not of items.
    """
    order = np.argsort(sizes)
    size, left = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    bounds = best_buckets(size, left, capacity, buckets) if bounds is None else np.asarray(bounds)
    used = np.zeros(len(size), np.int64)
    low = np.concatenate([[0], bounds[:-1]]) if len(bounds) else bounds
    runs, patterns, container = [], [], 0
    top = len(size) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            break
        bucket = int(np.searchsorted(bounds, size[top]))
        least = 0 if fill_gaps else low[bucket]
        gap, at, taken = capacity, top, []
        while gap > 0 and at >= 0:
            at = min(at, int(np.searchsorted(size, gap, side="right")) - 1)
            while at >= 0 and left[at] == 0:
                at -= 1
            if at < 0 or size[at] <= least:
                break
            n = min(left[at], gap // size[at])
            taken.append((at, n))
            gap -= n * size[at]
            at -= 1
        times = min(left[i] // n for i, n in taken)
        for i, n in taken:
            runs.append((size[i], used[i], n, container))
            used[i] += n * times
            left[i] -= n * times
        patterns.append((container, bounds[bucket]))
        container += times
    return Plan(bounds, np.array(runs, np.int64).reshape(-1, 4), int(container), np.array(patterns, np.int64).reshape(-1, 2))


def place(p: Plan, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Container of the items with these sizes and ranks."""
    runs = p.runs[np.lexsort((p.runs[:, 1], p.runs[:, 0]))]
    width = int(runs[:, 1].max(initial=0)) + 2
    wide = float(width) * float(runs[:, 0].max(initial=0) + 1)
    if wide < 2**62:
        at = np.searchsorted(runs[:, 0] * width + runs[:, 1], size * width + np.minimum(rank, width - 1), side="right") - 1
    else:  # too many items for one number
        at = np.empty(len(size), np.int64)
        for s in np.unique(size):
            lo, hi = np.searchsorted(runs[:, 0], [s, s + 1])
            mine = size == s
            at[mine] = lo + np.searchsorted(runs[lo:hi, 1], rank[mine], side="right") - 1
    return runs[at, 3] + (rank - runs[at, 1]) // runs[at, 2]


def pack(documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, buckets: int = BUCKETS, fill_gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spec_name, container_id, doc_id, piece, token_from, tokens, bucket_bound), and (spec_name, capacity_tokens, bucket_bound) of the buckets.

    Each text goes into a container of each capacity of ``specs`` (spec_name,
    capacity_tokens). A text of more tokens than the capacity is split into pieces of the
    whole capacity and one of the rest; no other is. Pieces count from 0.

    Method: the histogram of all pieces' sizes, which has at most capacity entries, is
    global; dynamic programming finds on it the length buckets with the least padding, and
    batches of the token budget form inside each bucket (:func:`plan`): only items of one
    bucket share a container, unless ``fill_gaps`` offers what a batch leaves to shorter
    buckets. Every item is then placed by its rank among those of its size; sizes that hold
    many items are ranked in parts.

    Null and empty texts have no tokens and take no place. Null or non-positive capacities
    and null names have no containers; repeated specs count once; equal texts are items of their own.
    """
    spark = documents.sparkSession
    found = specs.where("spec_name is not null and capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    counted = cut_lineage(token_counts(documents, ["doc_id"], vocabulary).where("tokens > 0"))
    cap, n = F.col("capacity"), F.col("tokens")
    # The list of capacities is a small table of parameters, no data.
    sizes = [(r[0], r[1]) for r in found.orderBy("spec_name", "capacity").collect()]
    layout = None
    for name, c in sizes:
        one = counted.select("doc_id", "tokens", F.lit(name).alias("spec_name"), F.lit(c).cast("long").alias("capacity"))
        layout = one if layout is None else layout.unionByName(one)
    columns = "spec_name string, container_id long, doc_id long, piece int, token_from long, tokens long, bucket_bound long"
    if layout is None:
        return spark.createDataFrame([], columns), spark.createDataFrame([], "spec_name string, capacity_tokens long, bucket_bound long")
    pieces = layout.select("spec_name", "capacity", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / cap)), lambda i: F.struct((i * cap).alias("token_from"), F.least(cap, n - i * cap).alias("tokens")))).alias("piece", "x"))
    pieces = pieces.select("spec_name", "capacity", "doc_id", "piece", "x.*").withColumn("key", F.concat_ws(":", "spec_name", "tokens"))
    table = pieces.groupBy("spec_name", "capacity", "tokens").count().toPandas()
    plans = {}
    for (name, c), g in table.groupby(["spec_name", "capacity"]):
        plans[name, c] = plan(g["tokens"].to_numpy(), g["count"].to_numpy(), int(c), buckets, fill_gaps)

    hot = hot_keys(pieces, "key")
    parted = with_parts(pieces, "key", hot).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"))
    rank = F.row_number().over(W.partitionBy("spec_name", "capacity", "tokens", "part").orderBy("doc_id", "piece")) - 1
    ranked = parted.withColumn("rank", rank.cast("long"))
    if hot:
        # Where each part of a hot size begins: a row for each part, so at most about rows / PART_ROWS.
        held = parted.where("parts > 1").groupBy("spec_name", "capacity", "tokens", "part").count()
        before = F.sum("count").over(W.partitionBy("spec_name", "capacity", "tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        begins = held.select("spec_name", "capacity", "tokens", "part", F.coalesce(before, F.lit(0)).alias("begin"))
        ranked = ranked.join(begins, ["spec_name", "capacity", "tokens", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("begin", F.lit(0)))
    shared = spark.sparkContext.broadcast(plans)

    def assign(batches):
        for batch in batches:
            out, bound = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for key, rows in batch.groupby(["spec_name", "capacity"]).indices.items():
                own, size = shared.value[key], batch["tokens"].to_numpy()[rows]
                out[rows] = place(own, size, batch["rank"].to_numpy()[rows])
                bound[rows] = own.bounds[np.searchsorted(own.bounds, size)]
            yield batch.assign(container_id=out, bucket_bound=bound)[["spec_name", "container_id", "doc_id", "piece", "token_from", "tokens", "bucket_bound"]]

    packed = ranked.select("spec_name", "capacity", "doc_id", "piece", "token_from", "tokens", "rank").mapInPandas(assign, columns)
    rows = [(name, int(c), int(b)) for (name, c), p in sorted(plans.items()) for b in p.bounds]
    return packed, spark.createDataFrame(rows, "spec_name string, capacity_tokens long, bucket_bound long")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, capacity_tokens, containers, pieces, documents, tokens, unused_tokens, fill): how well containers are filled."""
    each = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    whole = each.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    caps = specs.where("spec_name is not null and capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    room = F.col("containers") * F.col("capacity_tokens")
    return whole.join(caps, "spec_name").select(
        "spec_name", "capacity_tokens", "containers", "pieces", "tokens", "fullest", (room - F.col("tokens")).alias("unused_tokens"), (F.col("tokens") / room).alias("fill")
    )


def broken_rules(packed: DataFrame, documents: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_name, capacity_tokens, documents, over_capacity, needless_splits, mixed_buckets, tokens_lost, ids_skipped): all but the first three are 0 for a right packing.

    Counted are containers above the capacity or, without filled gaps, of several buckets;
    documents in more pieces than needed, or whose pieces don't have all their tokens once; and
    numbers that no container has.
    """
    caps = specs.where("spec_name is not null and capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    boxes = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t"), F.min("bucket_bound").alias("low"), F.max("bucket_bound").alias("high")).join(caps, "spec_name")
    box = boxes.groupBy("spec_name", "capacity_tokens").agg(
        F.count_if(F.col("t") > F.col("capacity_tokens")).cast("int").alias("over_capacity"), F.count_if(F.col("low") != F.col("high")).cast("int").alias("mixed_buckets"),
        (F.max("container_id") + 1 - F.count("*")).cast("int").alias("ids_skipped"),
    )
    each_cap = F.array(*[F.struct(F.lit(r[0]).alias("spec_name"), F.lit(r[1]).cast("long").alias("capacity_tokens")) for r in caps.collect()]).cast("array<struct<spec_name:string,capacity_tokens:bigint>>")
    sizes = token_counts(documents, ["doc_id"], vocabulary).where("tokens > 0").select("doc_id", F.col("tokens").alias("size"), F.explode(each_cap).alias("c")).select("doc_id", "size", "c.*")
    pieces = packed.groupBy("spec_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"), F.max(F.col("token_from") + F.col("tokens")).alias("last"))
    each = sizes.join(pieces, ["spec_name", "doc_id"], "full_outer")
    doc = each.groupBy("spec_name").agg(
        F.count("pieces").alias("documents"), F.count_if(F.col("pieces") > F.ceil(F.col("size") / F.col("capacity_tokens"))).cast("int").alias("needless_splits"),
        F.count_if(~F.col("t").eqNullSafe(F.col("size")) | ~F.col("last").eqNullSafe(F.col("size"))).cast("int").alias("tokens_lost"),
    )
    return box.join(doc, "spec_name").select("spec_name", "capacity_tokens", "documents", "over_capacity", "needless_splits", "mixed_buckets", "tokens_lost", "ids_skipped")
