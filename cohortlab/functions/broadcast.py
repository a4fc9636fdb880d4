"""Broadcast only what has a size bound.

``broadcast_if_bounded`` takes a bound that follows from the parameters (k
clusters, 2^n masks, a fixed dimension) and broadcasts when it is small.
``broadcast_if_small`` measures: it counts at most ``max_rows + 1`` rows and
falls back to a normal (shuffle) join above the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 1_000_000


def broadcast_if_bounded(df: DataFrame, bound: int, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if bound <= max_rows else df


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
