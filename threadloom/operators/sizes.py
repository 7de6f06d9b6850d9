"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it has no more than so many rows; else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
