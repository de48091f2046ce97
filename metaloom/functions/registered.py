"""Functions under a name for SQL: plain SQL functions that Catalyst inlines, and Arrow batches where Python is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Written in SQL, so that they become part of the plan: name, parameters, result, body.
SQL_FUNCTIONS = {
    "description_points": ("text STRING, most INT", "INT", "CAST(round(most * CASE WHEN octet_length(trim(coalesce(text, ''))) = 0 THEN 0.0 WHEN octet_length(trim(text)) < 20 THEN 0.2 WHEN octet_length(trim(text)) < 50 THEN 0.5 WHEN octet_length(trim(text)) < 100 THEN 0.8 ELSE 1.0 END) AS INT)"),
    "score_grade": ("score INT", "STRING", "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"),
    "norm_id": ("id STRING", "STRING", "nullif(lower(trim(id)), '')"),
    "text_similarity": ("a STRING, b STRING", "DOUBLE", "CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0D ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END"),
}


@F.pandas_udf(StringType())
def initials(names: pd.Series) -> pd.Series:
    """First letters of a name's words, in lower case; null for null."""
    return names.map(lambda n: None if n is None else "".join(w[0] for w in n.lower().replace("_", " ").replace("#", " ").split()))


@F.pandas_udf(DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """exp of the mean logarithm of positive values; an aggregate over one group's values."""
    import numpy as np

    good = values[values > 0]
    return float(np.exp(np.log(good.to_numpy(dtype=float)).mean())) if len(good) else None


@F.udtf(returnType=StructType([StructField("place", IntegerType()), StructField("word", StringType())]), useArrow=True)
class SplitWords:
    """A row for each word of a text, with its place from 0."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def register(spark: SparkSession) -> None:
    """Give the session all functions, as temporary ones."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("initials", initials)
    spark.udf.register("geometric_mean", geometric_mean)
    spark.udtf.register("split_words", SplitWords)
