"""A broadcast hint behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when at most ``max_rows`` rows are there, else a plain join.

    Counting reads ``df``, so pass a written or checkpointed table.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
