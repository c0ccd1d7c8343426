"""Bounded samples that don't pass through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, n: int, *key: str, seed: int = 0) -> DataFrame:
    """All rows if they are at most ``n``, else those whose hash of the key columns lies below n / rows: about
    ``n`` of distinct keys, the same ones in every run, chosen where they lie."""
    total = rows.count()
    if total <= n:
        return rows
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(2**53))
    return rows.filter(share < n / total)
