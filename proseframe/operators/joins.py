"""Joins with small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200_000
MOST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows of together most_bytes, which are counted first; else df as it is, for Spark to join by shuffle.

    For dictionaries and dimensions: Spark takes a table made from local rows for huge, and would
    rather broadcast the texts, or shuffle all rows to a few keys.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    rows, total = df.limit(most_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= most_rows and total <= most_bytes else df
