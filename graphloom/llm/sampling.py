"""Bounded samples without a sort or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, rows: int, size: int, *keys: Column | str) -> DataFrame:
    """About ``size`` of the ``rows`` rows of ``df``, never more than twice as many: those whose hash of ``keys`` is below
    size / rows of its range; all rows if there are no more. The same rows every time, whatever their order."""
    if rows <= size:
        return df
    cutoff = -(1 << 63) + (1 << 64) * size // rows
    return df.where(F.xxhash64(*keys) < F.lit(cutoff)).limit(2 * size)
