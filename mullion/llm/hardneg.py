"""Hard-negative mining by a vertical scan of blocks of vectors.

Vectors lie in blocks, a block in columns: one array per dimension, with its least and greatest value. An anchor reads a
block's dimensions in the order of its own largest components and adds up partial scores; what the dimensions still
unread can add at least and at most, from the columns' bounds, tells which candidates can no longer be among the best of
a score window. They leave the candidate set, and later dimensions are read for what remains. Scores are whole numbers and
exact. Anchors in parts meet the blocks in a grid: a task holds one part and one block, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mullion.llm.common import picked
from mullion.runtime import cut

BLOCK = 8192        # vectors of a block, about
PART = 512          # anchors of a part, about
STEP = 8            # dimensions read between two looks at the bounds
LARGEST = 1 << 24   # components reach less than this, so that scores fit 64 bits
FOUND = "anchor long, slot int, id long, row long, score long"


def whole_vectors(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null, not finite or too large."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / scale, F.lit(False)))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def blocks_of(rows: DataFrame, n_blocks: int, dims: int) -> DataFrame:
    """One row per block: block, ids, rows and labels, each dimension's column, and the least and greatest of each."""
    def build(key, table):
        table = table.combine_chunks()
        lists = table["vector"].chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        full = np.zeros((len(size), dims), np.int32)
        full[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        columns = np.ascontiguousarray(full.T)
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": raw(table["id"].to_numpy()), "rows": raw(table["row"].to_numpy()), "labels": raw(table["label"].to_numpy()),
                         "low": raw(columns.min(axis=1)), "high": raw(columns.max(axis=1)), "columns": pa.array([[c.tobytes() for c in columns]], pa.list_(pa.binary()))})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    return placed.groupBy("block").applyInArrow(build, "block int, ids binary, rows binary, labels binary, low binary, high binary, columns array<binary>")


def number_kind(dims: int, peak: int):
    """The narrowest kind of number that holds every score and partial score exactly."""
    most = dims * peak * peak
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def scan(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, candidates: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, k: int, step: int = STEP):
    """Candidates and exact scores of at least the ``k`` best, ties included, of every window [floor, ceiling] of scores.

    A candidate goes once no window can hold it: its least score is over the ceiling, or its greatest is under the floor or
    under the k-th best least score of those sure to lie in the window.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = np.stack((a * low[order], a * high[order]))
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    part = np.zeros(len(candidates), columns.dtype)
    for at in range(0, len(order), step):
        read = columns[order[at:at + step]]
        part = part + a[at:at + step] @ (read if len(candidates) == columns.shape[1] else read[:, candidates])
        down, up = least[min(at + step, len(order))], most[min(at + step, len(order))]
        alive = np.zeros(len(part), bool)
        for floor, ceiling in zip(floors, ceilings):
            sure = part[(part + down >= floor) & (part + up <= ceiling)]
            if len(sure) >= k:
                floor = max(floor, np.partition(sure, len(sure) - k)[len(sure) - k] + down)
            alive |= (part + up >= floor) & (part + down <= ceiling)
        if not alive.all():
            candidates, part = candidates[alive], part[alive]
        if not len(candidates):
            break
    return candidates, part


def search(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_parts: int, k: int, same: bool, kind) -> DataFrame:
    """Per anchor and window the best ``k`` rows of each block with the anchor's label, or with another: FOUND.

    ``anchors(row, label, vector, floors, ceilings)``; an anchor is not its own match. Ties go to the smaller id, then row.
    """
    limit = float("inf") if kind is not np.int64 else None

    def run(key, left, right):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            one = {c: left[c][0].as_py() for c in ("ids", "rows", "labels", "low", "high", "columns")}
            ids, rows, labels = (np.frombuffer(one[c], t) for c, t in (("ids", np.int64), ("rows", np.int64), ("labels", np.int64)))
            low, high = (np.frombuffer(one[c], np.int32).astype(kind) for c in ("low", "high"))
            columns = np.stack([np.frombuffer(c, np.int32).astype(kind) for c in one["columns"]]) if one["columns"] else np.zeros((0, len(ids)), kind)
            for me, label, vector, floors, ceilings in zip(*[right[c].to_pylist() for c in ("row", "label", "vector", "floors", "ceilings")]):
                anchor = np.zeros(len(columns), kind)
                anchor[:len(vector)] = vector
                if floors is None:
                    floors, ceilings = ([-limit], [limit]) if limit else ([-1 << 62], [1 << 62])
                fits = (labels == label) & (rows != me) if same else labels != label
                at, score = scan(columns, low, high, anchor, np.flatnonzero(fits), floors, ceilings, k)
                for slot, (floor, ceiling) in enumerate(zip(floors, ceilings)):
                    inside = np.flatnonzero((score >= floor) & (score <= ceiling))
                    if not len(inside):
                        continue
                    best = inside[np.lexsort((rows[at[inside]], ids[at[inside]], -score[inside]))[:k]]
                    for column, value in zip(out, (np.full(len(best), me), np.full(len(best), slot), ids[at[best]], rows[at[best]], score[best])):
                        column.append(value.astype(np.int64))
        flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({n: pa.array(v, pa.int32() if n == "slot" else pa.int64()) for n, v in zip(("anchor", "slot", "id", "row", "score"), flat)})

    tiles = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "*")
    asking = anchors.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int")).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "*")
    found = tiles.groupBy("part", "block").cogroup(asking.groupBy("part", "block")).applyInArrow(run, FOUND)
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors(id, label, vector)`` holds whole numbers; ``is_anchor`` is a condition on them. A score is the inner product,
    over the dimensions both have. An anchor's positives are its best ``positives`` other rows of its label; for each, the best
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's are its negatives.
    Higher scores come first, then smaller ids. Rows with a null id, label or vector take no part; rows that repeat an id are
    rows each, so a repeated anchor is answered each time. A positive without such rows, an anchor without positives and
    an empty table give none. Other columns don't count.
    """
    rows = picked(vectors.withColumn("asks", F.coalesce(is_anchor, F.lit(False))), id="id", label="label", vector="vector", asks="asks").dropna(subset=["id", "label", "vector"])
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint"), F.col("label").cast("bigint"), F.col("vector").cast("array<int>"), "asks")
    rows = cut(rows)
    peak = F.max(F.coalesce(F.greatest(F.array_max("vector"), -F.array_min("vector")), F.lit(0)))
    n, asking, dims, peak = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(peak, F.lit(0))).first()
    n_blocks, n_parts, kind = max(1, -(-n // block)), max(1, -(-asking // part)), number_kind(dims, peak)
    stored = cut(blocks_of(rows.drop("asks"), n_blocks, dims))
    anchors = rows.filter("asks")
    none = F.lit(None).cast("array<long>")
    near = search(stored, anchors.select("row", "label", "vector", none.alias("floors"), none.alias("ceilings")), n_blocks, n_parts, positives, True, kind)
    near = cut(near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Whole scores n with low * p <= 100 * n <= high * p; slots follow the positives' rank.
    below = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("bigint")  # noqa: E731  exact: x - pmod is a multiple of 100
    floor, ceiling = -below(F.col("positive_score") * -low), below(F.col("positive_score") * high)
    bounds = near.withColumn("bound", F.struct("slot", floor.alias("floor"), ceiling.alias("ceiling")))
    bounds = bounds.groupBy("anchor").agg(F.array_sort(F.collect_list("bound")).alias("bound"))  # at most ``positives`` each
    asked = anchors.join(bounds.withColumnRenamed("anchor", "row"), "row").select("row", "label", "vector", F.col("bound.floor").alias("floors"), F.col("bound.ceiling").alias("ceilings"))
    far = search(stored, asked, n_blocks, n_parts, negatives, False, kind)
    far = far.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(far, ["anchor", "slot"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
