"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from metaloom.functions.text import norm_id, norm_ids
from metaloom.plans.skew import PART_ROWS, hot_keys, with_parts

START, END, REF = 0, 1, 2


def references(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(ref_table, row_id, ref_id, at) of each id that a row names, in unique_id or in its list.

    ``tables`` maps a table's name to its rows and the name of its list column. Within a row
    an id counts once. Null and blank ids and list elements name nothing.
    """
    out = None
    for name, (df, ids) in tables.items():
        named = F.array_distinct(F.array_union(F.array_compact(F.array(norm_id("unique_id"))), norm_ids(ids)))
        part = df.where(F.col("recorded_at").isNotNull()).select(
            F.lit(name).alias("ref_table"), "row_id", F.explode(named).alias("ref_id"), F.col("recorded_at").alias("at")
        )
        out = part if out is None else out.unionByName(part)
    return out


def orphan_references(tables: dict[str, tuple[DataFrame, str]], entities: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(ref_table, period, row_id, ref_id, reason): the references whose entity does not exist when they are recorded.

    Method: references and the validity intervals of the parent keys are partitioned and
    sorted by (key, time) together, and one pass over the merged stream keeps the number of
    intervals that are open. A key that more than ``part_rows`` references name is split into
    parts of at most about so many; its intervals, and only those, are repeated for each part.

    An entity exists at t if one of its rows has created_at <= t and deleted_at null or > t.
    reason: ``deleted`` if some row was created by then, else ``late`` if one is created
    afterwards, else ``missing``. period is the month of recorded_at.

    Null cases: a row without recorded_at names no instant and gives nothing; an entity row
    without id or created_at, or deleted when or before it was created, is never valid.
    Repeated rows (same row_id) are copies and count once. Empty tables give no rows or, as
    entities, make every reference ``missing``. Further columns are ignored.
    """
    refs = references(tables)
    hot = hot_keys(refs, "ref_id", part_rows)
    key = F.col("id")
    stream = with_parts(refs, "ref_id", hot).select(
        F.col("ref_id").alias("id"),
        F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"),
        F.col("at"), F.lit(REF).alias("kind"), "ref_table", "row_id",
    )
    valid = entities.select(norm_id("unique_id").alias("id"), F.col("created_at"), F.col("deleted_at")).where(
        key.isNotNull() & F.col("created_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("created_at")))
    )
    valid = with_parts(valid, "id", hot).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bounds = valid.select(
        "id", "part",
        F.explode(F.filter(
            F.array(F.struct(F.col("created_at").alias("at"), F.lit(START).alias("kind")), F.struct(F.col("deleted_at").alias("at"), F.lit(END).alias("kind"))),
            lambda x: x["at"].isNotNull(),
        )).alias("x"),
    ).select("id", "part", "x.at", "x.kind", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("long").alias("row_id"))

    whole = W.partitionBy("id", "part")
    so_far = whole.orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    started = F.when(F.col("kind") == START, 1)
    merged = stream.unionByName(bounds).select(
        "*", F.sum(step).over(so_far).alias("open"), F.count(started).over(so_far).alias("before"), F.count(started).over(whole).alias("ever")
    )
    found = merged.where((F.col("kind") == REF) & (F.col("open") == 0)).select(
        "ref_table", F.substring(F.col("at").cast("string"), 1, 7).alias("period"), "row_id", F.col("id").alias("ref_id"),
        F.when(F.col("before") > 0, "deleted").when(F.col("ever") > 0, "late").otherwise("missing").alias("reason"),
    )
    return found.dropDuplicates(["ref_table", "row_id", "ref_id"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, period and reason, with the number of distinct ids."""
    return orphans.groupBy("ref_table", "period", "reason").agg(
        F.count("*").alias("orphan_references"), F.countDistinct("ref_id").alias("orphan_ids"), F.countDistinct("row_id").alias("orphan_rows")
    )
