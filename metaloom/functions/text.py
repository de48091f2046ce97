"""Column expressions on ids and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Unicode counts as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def norm_id(col: Column | str) -> Column:
    """An id without surrounding white space and in lower case; null if nothing is left."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.trim(col, F.lit(WHITE_SPACE))), F.lit(""))


def norm_ids(col: Column | str) -> Column:
    """The distinct ids of a list that name something; an empty list for null."""
    col = F.col(col) if isinstance(col, str) else col
    named = F.filter(F.transform(col, norm_id), lambda x: x.isNotNull())
    return F.array_distinct(F.coalesce(named, F.array().cast("array<string>")))
