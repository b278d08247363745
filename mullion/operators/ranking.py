"""Top-k per key that never ranks a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PARTS = 64


def smallest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key: ranked within hash parts of each key, then across their winners."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
    first = (df.withColumn("_part", part)
             .withColumn(rank, F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
             .filter(F.col(rank) <= k).drop("_part"))
    return (first.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
            .filter(F.col(rank) <= k))
