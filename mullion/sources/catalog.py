"""Typed loading of the takeoff tables and of the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from mullion import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def load_catalog(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Takeoff tables as typed frames, also registered as temp views.

    Reading with the declared schema keeps column pruning and filters at the
    scan, and yields nulls for columns an older writer did not have.
    """
    return _load(spark, folder, names or list(schemas.TAKEOFF))


def load_prices(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _load(spark, folder, list(schemas.PRICES))


def _load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    known = {**schemas.TAKEOFF, **schemas.PRICES}
    out = {}
    for name in names:
        out[name] = spark.read.schema(known[name]).parquet(os.path.join(folder, f"{name}.parquet"))
        out[name].createOrReplaceTempView(name)
    return out
