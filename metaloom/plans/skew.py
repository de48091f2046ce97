"""Splitting of hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one part of a key: what a task sorts at once, whatever the size of the whole.
PART_ROWS = 500_000


def hot_keys(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> dict[str, int]:
    """Number of parts for each value of ``key`` that more than ``part_rows`` rows hold.

    One pass; counts are aggregated before the shuffle. The result has at most
    rows / part_rows entries, since no more values can hold that many rows each.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > part_rows)
    return {r[0]: int(-(-r[1] // part_rows)) for r in counts.collect()}


def with_parts(df: DataFrame, key: str, hot: dict[str, int], name: str = "parts") -> DataFrame:
    """``df`` with the number of parts of each row's key; 1 for all but hot ones.

    The hot keys are at hand, so their number is known: they are broadcast up to a million
    (some ten MB), and joined as any other table beyond.
    """
    if not hot:
        return df.withColumn(name, F.lit(1))
    known = df.sparkSession.createDataFrame(list(hot.items()), f"`_key` {df.schema[key].dataType.simpleString()}, `_n` int")
    if len(hot) <= 1_000_000:
        known = F.broadcast(known)
    return df.join(known, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(1))).drop("_key", "_n")
