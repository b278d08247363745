"""Feeds: job state, corrections, progress, cost and intake as Structured Streaming.

State that must outlive a run is a keyed table: each micro-batch is reduced to its
newest row per key and merged with the stored one, so replays change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mullion.operators.overlay import latest

# Minutes after which a job that has not moved counts as left behind.
STALE_MINUTES, PLAN_STALE_MINUTES = 45, 120


def as_seen(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs as a caller should see them: one still reading past its limit is reported failed; nothing is rewritten."""
    limit = F.when(F.col("kind") == "plan", F.lit(PLAN_STALE_MINUTES * 60_000_000).cast("bigint")).otherwise(F.lit(STALE_MINUTES * 60_000_000).cast("bigint"))
    stale = (F.col("status") == "reading") & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp")) > limit)
    return jobs.withColumns({"stale": stale, "status": F.when(stale, "failed").otherwise(F.col("status"))})


class LatestTable:
    """Newest row per key in a folder of Parquet versions, merged batch by batch.

    Each merge writes a new version and then names it in a one-row pointer table, so a
    task or driver lost half-way leaves the last whole version in place. A batch seen
    before is skipped by its id.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.folder, self.keys, self.order = spark, folder, list(keys), list(order)

    def _pointer(self) -> int | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, "done"))
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
        done = [int(n) for n in names if n.isdigit()]
        return max(done) if done else None

    def read(self) -> DataFrame | None:
        v = self._pointer()
        return None if v is None else self.spark.read.parquet(os.path.join(self.folder, f"v={v}"))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        last = self._pointer()
        if last is not None and batch_id <= last:
            return
        stored = self.read()
        rows = batch if stored is None else stored.unionByName(batch)
        latest(rows, self.keys, self.order).select(*batch.columns).write.mode("overwrite").parquet(os.path.join(self.folder, f"v={batch_id}"))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, "done", str(batch_id)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)


def run_feed(stream: DataFrame, table: LatestTable, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Drives a stream into a latest-per-key table until its input is used up."""
    q = (stream.writeStream.foreachBatch(lambda b, i: table.merge(shape(b), i)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read()


COST_SCHEMA = "window_start timestamp, project_id bigint, app_version string, usd decimal(38,4), runs bigint, newest timestamp, batch bigint"


def cost_feed(runs: DataFrame, folder: str, checkpoint: str, run_key: Sequence[str] = ("run_id",), replays: str = "1 day",
              width: str = "1 hour") -> None:
    """Adds up cost and runs per project, version and window of a stream, one folder of partial sums per micro-batch.

    Sums merge, so a batch adds its own rows only, late ones too, and nothing stored is rewritten. A batch that is run again
    overwrites its folder. A run seen before is passed over while the watermark, ``replays`` behind the newest run, has
    not gone by it; rows older than that are past what the feed can tell from replays and are left out.
    """
    spark = runs.sparkSession
    spark.createDataFrame([], COST_SCHEMA).drop("batch").write.mode("overwrite").parquet(os.path.join(folder, "batch=-1"))  # a feed without rows reads as empty

    def add(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(F.window("created_at", width).alias("w"), "project_id", "app_version")
         .agg(F.sum("cost_usd").cast("decimal(38,4)").alias("usd"), F.count(F.lit(1)).alias("runs"), F.max("created_at").alias("newest"))
         .select(F.col("w.start").alias("window_start"), F.col("project_id").cast("bigint"), "app_version", "usd", "runs", "newest")
         .write.mode("overwrite").parquet(os.path.join(folder, f"batch={batch_id}")))

    once = runs.withWatermark("created_at", replays).dropDuplicatesWithinWatermark(list(run_key))
    once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cost_windows(spark: SparkSession, folder: str, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Every window of a cost feed so far, open ones too: project_id, app_version, window_start, usd, runs, closed, batch.

    A window is closed once the newest run of the feed is ``late`` past its end. ``batch`` is the last that added to it: a
    reader who took the window at an earlier batch replaces what it took.
    """
    parts = spark.read.schema(COST_SCHEMA).parquet(folder)
    newest = parts.agg(F.max("newest").alias("_newest"))  # one row
    sums = parts.groupBy("window_start", "project_id", "app_version").agg(F.sum("usd").alias("usd"), F.sum("runs").alias("runs"), F.max("batch").alias("batch"))
    end = F.col("window_start") + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {late}")
    return (sums.withColumn("_one", F.lit(1)).join(F.broadcast(newest.withColumn("_one", F.lit(1))), "_one")
            .withColumn("closed", end <= F.col("_newest")).drop("_one", "_newest"))


def intake(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Idempotent intake: one document per (project, sha, reader version) within the watermark."""
    return files.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["project_id", "sha256", "reader_version"])


def needs_reading(docs: DataFrame, current_version: int) -> DataFrame:
    """Newest reading per (project, sha), flagged when an older reader made it."""
    newest = docs.groupBy("project_id", "sha256").agg(F.max("reader_version").alias("reader_version"))
    return newest.withColumn("reread", F.col("reader_version") < current_version)
