"""Bounded, repeatable samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by hash of ``key`` (with unique keys, rarely more than 1 % above); all of them if there are fewer.

    Each task passes on its share only, so what reaches the driver doesn't grow with the data, and the same rows come every time.
    """
    n = df.count()
    if n <= rows:
        return df
    keep = max(1, round(1_000_000_000 * rows / n))
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000_000)) < keep)
