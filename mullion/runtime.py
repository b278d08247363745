"""Session-level helpers: checkpointing that survives executor loss and
size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when its plan's own size estimate is below this.
BROADCAST_BYTES = 64 * 1024 * 1024
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on local[*]."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="mullion-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and drop its lineage, and its shuffle files with it.

    Once the checkpoint is written nothing reads those files again; left to the driver's garbage collection they pile
    up over the rounds of an operator.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def settled(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``cut``, then partitions of about ``rows`` rows, by counting them: later steps over a small frame stay few tasks."""
    done = cut(df)
    return done.coalesce(done.count() // rows + 1)


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint when the optimizer's own size estimate allows it.

    Without a bound that can be shown the frame is returned as it is, and the
    join shuffles (AQE may still convert it once the real size is known).
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return F.broadcast(df) if int(str(plan.stats().sizeInBytes())) <= BROADCAST_BYTES else df
