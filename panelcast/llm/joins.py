"""Joins whose small side is checked before it is sent anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 500_000      # narrow rows (a few numbers each) that may go to all executors


def few(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` (a stored table), to be broadcast if it has at most ``rows``
    rows; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
