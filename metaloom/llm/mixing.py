"""Mixing sources to target weights."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.text import norm_id
from metaloom.llm.tokens import VOCABULARY, token_counts
from metaloom.session import cut_lineage

#: Documents that one task balances; those it leaves undecided go on to the next level.
BLOCK_ROWS = 20_000
EPS = 1e-9
#: Tasks of one level; more groups than these share tasks.
MOST_TASKS = 20_000
#: A document with more than this share of its block's tokens is decided before the others.
LARGE = 0.001
COPIES = "mix_name string, source string, doc_id long, tokens long, times long, chance double, copies long"


def source_name(col: Column | str) -> Column:
    """A source without surrounding white space, in lower case, with ``_`` for ``-`` and inner white space."""
    return F.regexp_replace(norm_id(col), r"[\s-]+", "_")


def null_vector(rows: list[list[float]], active: list[int]) -> list[float] | None:
    """A vector u other than 0 that is orthogonal to the active columns of one or two rows; None if there is none.

    Closed forms: of three columns and two rows the cross product of the rows; of two columns
    and one row both swapped, one negated. Parallel rows count as one.
    """
    a = [rows[0][i] for i in active]
    if len(active) < 2:
        return None
    if len(rows) == 2:
        b = [rows[1][i] for i in active]
        scale = 1e-12 * max(map(abs, a)) * max(map(abs, b))
        if len(active) == 3:
            u = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
            if max(map(abs, u)) > scale:
                return u
        elif abs(a[0] * b[1] - a[1] * b[0]) > scale:
            return None
        if not any(a):
            a = b
    u = [a[1], -a[0]] if a[0] or a[1] else [1.0, -1.0]
    return u + [0.0] * (len(active) - 2)


def flight(chance: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of the cube method: chances moved to 0 or 1 until at most as many as constraints are left between.

    ``balance`` has one or two rows, a column for each unit: what it adds to each constraint.
    The active set is one unit more than there are constraints; it moves along the null space
    of its columns, in one of both directions at random so that expectations stay, until a
    chance is 0 or 1.
    """
    p, rows = chance.astype(np.float64).tolist(), balance.tolist()
    waiting = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    coins = rng.random(len(waiting) + 1).tolist()
    want, active, next_, toss = len(rows) + 1, [], 0, 0
    while True:
        while len(active) < want and next_ < len(waiting):
            active.append(waiting[next_])
            next_ += 1
        u = null_vector(rows, active)
        if u is None:
            return np.array(p)
        most = max(map(abs, u))
        up = down = float("inf")
        for i, x in zip(active, u, strict=True):
            x /= most
            if x > EPS:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < -EPS:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        step = up if coins[toss] * (up + down) < down else -down
        toss += 1
        for i, x in zip(active, u, strict=True):
            moved = p[i] + step * x / most
            p[i] = 0.0 if moved < EPS else 1.0 if moved > 1 - EPS else moved
        active = [i for i in active if EPS < p[i] < 1 - EPS]


def land(chance: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Landing phase: of all ways to decide the few open units the one that leaves the constraints nearest."""
    open_ = np.flatnonzero((chance > EPS) & (chance < 1 - EPS))
    if not len(open_):
        return np.round(chance)
    scale = np.maximum(np.abs(balance[:, open_]).max(axis=1), 1e-300)
    goal = balance[:, open_] @ chance[open_]
    # Token totals come first, document totals decide between equals.
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: tuple(np.round(np.abs(balance[:, open_] @ np.array(x) - goal) / scale, 9)))
    out = np.round(chance)
    out[open_] = best
    return out


def settle_large(chance: np.ndarray, load: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the few documents that hold much of the block's tokens, before the others fly.

    Left to the end, one of them could only land far off. They fly on token totals alone;
    what their decision adds or takes is spread over the chances of all others, those that
    reach 0 or 1 handing on the rest, so that no token of the total is lost. Where the
    others cannot make up for it, the large ones fly with them.
    """
    tokens = load[0]
    order = np.argsort(-tokens, kind="stable")
    large = order[(tokens[order] > LARGE * tokens.sum()) & (np.cumsum(tokens[order]) < 0.3 * tokens.sum())]
    if not len(large) or len(large) == len(chance):
        return chance
    out = chance.copy()
    out[large] = land(flight(chance[large], load[:1, large], rng), load[:1, large])
    rest = np.setdiff1d(np.arange(len(chance)), large)
    p, t = chance[rest], tokens[rest]
    goal = chance @ tokens - out[large] @ tokens[large]
    if not 0 <= goal <= t.sum():
        return chance
    low, high = -1.0, 1.0
    for _ in range(100):  # the total of tokens rises with the shift
        shift = (low + high) / 2
        low, high = (shift, high) if np.clip(p + shift, 0, 1) @ t < goal else (low, shift)
    out[rest] = np.clip(p + high, 0, 1)
    return out


def _block(first: bool, last: bool):
    def balance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        rng = np.random.default_rng(int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF)
        load = np.vstack([pdf["tokens"].to_numpy(np.float64), np.ones(len(pdf))])
        # Large documents fly first, equal ones in random order, so that those left to land are small.
        order = np.lexsort((rng.random(len(pdf)), -load[0]))
        chance = pdf["chance"].to_numpy(np.float64)
        if first:
            chance = settle_large(chance, load, rng)
        chance[order] = flight(chance[order], load[:, order], rng)
        if last:
            chance = land(chance, load)
        done = (chance <= EPS) | (chance >= 1 - EPS)
        pdf["copies"] = pd.array(np.where(done, pdf["times"] + np.round(chance).astype(np.int64), -1), "Int64")
        pdf["chance"] = np.where(done, np.round(chance), chance)
        return pdf[["mix_name", "source", "doc_id", "tokens", "times", "chance", "copies"]]

    return balance


def targets(sizes: DataFrame, mixes: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, source_documents, source_tokens, weight): how often, on average, each source is used.

    The mix is as large as its sources allow: the scarcest, in proportion to its share, is
    used max_repeats times. Sources without documents can't contribute; the others keep their
    proportions, so each share is divided by the sum of the shares that can be met.
    """
    clean = mixes.where("mix_name is not null and target_share > 0").select("mix_name", source_name("source").alias("source"), "target_share", "max_repeats")
    clean = clean.where("source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    known = clean.join(sizes, "source", "left").withColumn("room", F.col("source_tokens") * F.coalesce(F.greatest(F.col("max_repeats"), F.lit(0)), F.lit(1)) / F.col("target_share"))
    whole = known.groupBy("mix_name").agg(F.min(F.when(F.col("room") > 0, F.col("room"))).alias("total"))
    return known.join(whole, "mix_name").select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("source_documents", F.lit(0)).alias("source_documents"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.when(F.col("room") > 0, F.col("total") * F.col("target_share") / F.col("source_tokens")).otherwise(0.0).alias("weight"),
    )


def mix(documents: DataFrame, mixes: DataFrame, vocabulary: str = VOCABULARY, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(mix_name, source, doc_id, tokens, copies) of the documents drawn, and the report of each source's share.

    ``documents`` has doc_id, text and source, ``mixes`` mix_name, source, target_share and
    max_repeats. Sources are compared by :func:`source_name`; documents without source, or
    without tokens, are not drawn. max_repeats null counts as 1, below 1 as never; rows with a
    null mix or source or a share that isn't positive are ignored, repeated ones add up.
    doc_id is unique; should rows repeat, each is drawn on its own.

    Method: a source's weight (:func:`targets`) is the number of times each of its documents is
    used; the whole part is repeated, the rest is the chance of one more use. The cube
    method turns chances into decisions while the source's totals of tokens and documents
    stay: blocks of at most about ``block_rows`` documents fly on their own, each leaves at most two
    undecided, which form the next level's blocks; the last few land. So a source of any
    size is balanced without being gathered.
    """
    sized = cut_lineage(token_counts(documents.withColumn("source", source_name("source")).where("source is not null"), ["doc_id", "source"], vocabulary).where("tokens > 0"))
    sizes = sized.groupBy("source").agg(F.count("*").alias("source_documents"), F.sum("tokens").alias("source_tokens"))
    goal = cut_lineage(targets(sizes, mixes))
    chance = F.col("weight") - F.floor("weight")
    near = (chance < 1e-6) | (chance > 1 - 1e-6)
    todo = sized.join(goal.where("weight > 0").select("mix_name", "source", "weight"), "source").select(
        "mix_name", "source", "doc_id", "tokens", F.when(near, F.round("weight")).otherwise(F.floor("weight")).cast("long").alias("times"), F.when(near, 0.0).otherwise(chance).alias("chance")
    )
    most, groups = goal.agg(F.max("source_documents"), F.count(F.when(F.col("weight") > 0, 1))).first()
    most = most or 0
    done = todo.where("chance = 0").select("mix_name", "source", "doc_id", "tokens", F.col("times").alias("copies"))
    left, blocks, level = todo.where("chance > 0"), -(-most // block_rows), 0
    while True:
        blocks = max(1, blocks)
        keyed = left.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(blocks)))
        # As many tasks as groups, which adaptive execution would merge into one as they are few bytes.
        spread = keyed.select("mix_name", "source", "block", "doc_id", "tokens", "times", "chance").repartition(max(1, min(2 * groups * blocks, MOST_TASKS)), "mix_name", "source", "block")
        flown = cut_lineage(spread.groupBy("mix_name", "source", "block").applyInPandas(_block(level == 0, blocks == 1), COPIES))
        done = done.unionByName(flown.where("copies >= 0").select("mix_name", "source", "doc_id", "tokens", "copies"))
        if blocks == 1:
            break
        left, blocks, level = flown.where("copies < 0").drop("copies"), -(-2 * blocks // block_rows), level + 1
    drawn = done.where("copies > 0")
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("mix_documents"), F.max("copies").alias("most_copies"))
    total = got.groupBy("mix_name").agg(F.sum("mix_tokens").alias("total"))
    report = goal.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left").select(
        "mix_name", "source", "target_share", "max_repeats", "source_documents", "source_tokens", "weight",
        F.coalesce("mix_documents", F.lit(0)).alias("mix_documents"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("mix_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
    )
    return drawn, report


def kept_rules(drawn: DataFrame, report: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(mix_name, source, max_repeats, source_documents, cap_kept, target_met) of each target.

    cap_kept: no document is drawn more often than max_repeats, counted in the drawn rows.
    target_met: the source has its share of the tokens of all sources that have any, within
    ``tolerance`` of it or half its longest document; one without documents has nothing.
    """
    got = drawn.groupBy("mix_name", "source").agg(F.max("copies").alias("most"), F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("tokens").alias("longest"))
    total = got.groupBy("mix_name").agg(F.sum("t").alias("total"))
    can = report.where("source_tokens > 0").groupBy("mix_name").agg(F.sum("target_share").alias("shares"))
    both = report.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left").join(can, "mix_name", "left")
    want = F.col("target_share") / F.col("shares") * F.col("total")
    met = F.abs(F.coalesce("t", F.lit(0)) - want) <= F.greatest(tolerance * want, F.col("longest") / 2)
    return both.select(
        "mix_name", "source", "max_repeats", "source_documents", (F.coalesce("most", F.lit(0)) <= F.greatest("max_repeats", F.lit(0))).alias("cap_kept"),
        F.when(F.col("source_documents") == 0, F.col("t").isNull()).otherwise(F.coalesce(met, F.lit(False))).alias("target_met"),
    )
