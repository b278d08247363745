"""Hard negatives against a scan of all pairs, on ties, repeated vectors, nulls, other lengths and no rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mullion.llm import hardneg

SCHEMA = "id bigint, embedding array<double>, label int, row int, rank string, block int, score int"


def rounded(e):
    if e is None or any(x is None or not math.isfinite(x) for x in e):
        return None
    return [math.floor(256 * x) for x in e]


def plain(rows, every, positives=5, negatives=10):
    ok = [(i, rounded(e), label) for i, e, label in rows if i is not None and rounded(e) is not None and label is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for me, (i, v, label) in enumerate(ok):
        if i % every:
            continue
        near = sorted((-dot(v, w), j) for at, (j, w, l) in enumerate(ok) if at != me and l == label)[:positives]
        for p, j in near:
            far = sorted((-dot(v, w), n) for n, w, l in ok if l != label and 30 * -p <= 100 * dot(v, w) <= 90 * -p)[:negatives]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(far, 1)]
    return sorted(out)


def mined(spark, rows, every, **sizes):
    df = spark.createDataFrame([(*r, 1, "r", 2, 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hardneg.mine(df.withColumn("vector", hardneg.whole_vectors(F.col("embedding"))), F.col("id") % every == 0, **sizes).collect())


def test_random_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 24))
    v[:300] = v[0] + rng.normal(size=(300, 24)) * 0.2  # a crowd around one direction
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(900)]
    want = plain(rows, 50)
    assert len(want) > 300
    assert mined(spark, rows, 50, block=128, part=5) == want
    assert mined(spark, rows, 50) == want


def test_ties_repeats_nulls_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 7) % 5) / 4, 0.5, -(i % 3) / 2], i % 2) for i in range(300)]
    rows += [(100, [1.0, 0.5, 0.0], 0), (100, [1.0, 0.5, 0.0], 0), (7, [1.0, 0.5, 0.0], 1), (7, [1.0, 0.5, 0.0], 1)]  # repeated ids
    rows += [(None, [1.0, 1.0, 1.0], 0), (500, None, 1), (600, [1.0, None, 1.0], 1), (700, [nan, 1.0, 1.0], 0), (800, [inf, 0.0, 0.0], 0), (900, [1.0, 1.0, 1.0], None)]
    rows += [(1000, [-1.0, -1.0, -1.0], 3), (1100, [], 0), (1200, [2.0], 0), (1300, [0.0, 0.0, 0.0], 1), (1400, [300.0, -200.5, 7.0], 1), (1401, [250.0, -100.5, 7.0], 1)]
    assert mined(spark, rows, 100, block=40, part=2) == plain(rows, 100)


def test_one_label_or_no_rows(spark):
    assert mined(spark, [(i, [1.0, 2.0], 1) for i in range(30)], 10) == []
    assert mined(spark, [(0, [1.0], 1)], 10) == []
    assert mined(spark, [], 10) == []


@pytest.mark.parametrize("dims, peak, kind", [(64, 256, np.float32), (64, 4096, np.float64), (64, 1 << 24, np.int64)])
def test_scores_are_exact(dims, peak, kind):
    assert hardneg.number_kind(dims, peak) is kind
    rng = np.random.default_rng(1)
    columns = rng.integers(1 - peak, peak, (dims, 500))
    anchor = rng.integers(1 - peak, peak, dims)
    exact = columns.T @ anchor
    top = [-np.inf] if kind is not np.int64 else [-1 << 62]
    high = [np.inf] if kind is not np.int64 else [1 << 62]
    at, score = hardneg.scan(columns.astype(kind), columns.min(axis=1).astype(kind), columns.max(axis=1).astype(kind), anchor.astype(kind), np.arange(500), top, high, 7)
    assert set(np.argsort(-exact)[:7]) <= set(at.tolist()) and (score == exact[at]).all() and len(at) < 500
