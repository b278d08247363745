"""Session used by tests, the bench and the checker (the cluster brings its own)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "mullion", cores: str | None = None) -> SparkSession:
    n = cores or os.environ.get("BENCH_CPUS") or "8"
    spark = (SparkSession.builder.master(f"local[{n}]").appName(app)
             .config("spark.sql.shuffle.partitions", n)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("MULLION_CHECKPOINTS", "/tmp/mullion-checkpoints"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
