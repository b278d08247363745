"""Ordered folds per key: running aggregates, clusters, coverage and cuts.

Running aggregates are two-level. Rows are ranged into buckets of the ordering
value, each bucket is folded on its own, and only one summary row per bucket is
carried along the key. A key holding most of the table is so spread over its buckets.
Without a bucket (or a width) a key is one printed line, page or sheet, whose rows came out of one
task anyway: it is folded in a plain window, and folds on the same key then share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mullion.runtime import cut


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _over(kind: str, value: Column, w) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(w)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    return F.greatest(carry, local) if kind == "max" else F.least(carry, local)


def known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in ``columns``: what an equi join on them keeps."""
    return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def running(df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence[str],
            aggs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Adds running aggregates per key in ``order``; ``bucket`` must not decrease along it.

    ``aggs`` maps a new column to (sum | max | min | last, value); ``inclusive=False``
    looks at the rows before the current one only. ``bucket`` is None where a key has few rows.
    Rows with a null in the keys or the first ordering value are left out of the result.
    """
    keys, order = list(keys), list(order)
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        over = {n: _over(k, v, w) for n, (k, v) in aggs.items()}
        done = df.select("*", *[(F.coalesce(c, F.lit(0)) if aggs[n][0] == "sum" else c).alias(n) for n, c in over.items()])
        return known(done, [*keys, order[0]])
    d = df.withColumn("_bucket", bucket)
    w = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    totals = d.groupBy(*keys, "_bucket").agg(*[_total(k, v, order).alias(f"_c_{n}") for n, (k, v) in aggs.items()])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "_bucket", *[_over(k, F.col(f"_c_{n}"), before).alias(f"_c_{n}") for n, (k, _) in aggs.items()])
    local = d.select("*", *[_over(k, v, w).alias(f"_l_{n}") for n, (k, v) in aggs.items()])
    return (local.join(carry, [*keys, "_bucket"])
            .select(*df.columns, *[_merge(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in aggs.items()]))


def upper_median(value: str) -> Column:
    """sorted[n // 2] of the non-null values, as a mergeable aggregate."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def lower_quartile(value: str) -> Column:
    """sorted[n // 4] of the non-null values."""
    return F.expr(f"percentile_disc(0.75) WITHIN GROUP (ORDER BY {value} DESC)")


def ranked_before(points: DataFrame, queries: DataFrame, keys: Sequence[str], stretch: int = 256) -> DataFrame:
    """Adds ``below`` to ``queries(keys, id, at, value)``: how many ``points(keys, at, value)`` of the key stand earlier and lower.

    This gives running order statistics: the running median is under a value when more than half of what came before is.
    A query meets the points of its own stretch of ``at``; the stretches before it are a few blocks of 1, 2, 4, ... stretches, and
    in each block the distinct values are counted up in order. No key and no block is gathered: both steps are spread over
    buckets of position and of value.
    """
    keys = list(keys)
    here = lambda df: df.withColumn("_s", F.floor(F.col("at") / stretch).cast("bigint"))
    p, q = here(points.select(*keys, "at", "value")), here(queries)
    near = q.join(p.select(*keys, "_s", F.col("at").alias("_at"), F.col("value").alias("_v")), [*keys, "_s"]).filter("_at < at AND _v < value")
    # Block b of level l holds stretches b * 2^l to (b + 1) * 2^l - 1; a query looks at one block for each bit set in its stretch.
    far = q.filter("_s > 0").select(*keys, "id", "value", "_s", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_s"))).cast("int"))).alias("_l"))
    far = far.filter(F.expr("shiftright(_s, _l) % 2 = 1")).withColumn("_b", F.expr("shiftright(_s, _l) - 1"))
    last = q.groupBy(*keys).agg(F.max("_s").alias("_last")).filter("_last > 0")
    held = p.join(last, keys).select(*keys, "value", "_s", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_last"))).cast("int"))).alias("_l"))
    held = held.withColumn("_b", F.expr("shiftright(_s, _l)")).filter("_b % 2 = 0").groupBy(*keys, "_l", "_b", "value").agg(F.count(F.lit(1)).alias("_n"))
    both = held.select(*keys, "_l", "_b", "value", "_n", F.lit(None).cast("string").alias("id"), F.lit(1).alias("_kind")).unionByName(
        far.select(*keys, "_l", "_b", "value", F.lit(0).cast("bigint").alias("_n"), "id", F.lit(0).alias("_kind")))
    bucket = F.when(F.col("value") > 0, F.floor(F.log2("value") * 1024)).otherwise(-1 << 40)
    counted = running(both, [*keys, "_l", "_b"], bucket, ["value", "_kind"], {"_sum": ("sum", F.col("_n"))}, inclusive=False).filter("_kind = 0")
    below = near.select("id", F.lit(1).cast("bigint").alias("_n")).unionByName(counted.select("id", F.col("_sum").alias("_n")))
    below = below.groupBy("id").agg(F.sum("_n").alias("below"))
    return queries.join(below, "id", "left").withColumn("below", F.coalesce("below", F.lit(0)))


def ranged(value: str, width: float | None) -> Column | None:
    """The bucket of a value, none without a width."""
    return None if width is None else F.floor(F.col(value) / width)


def chained(df: DataFrame, keys: Sequence[str], start: str, end: str, tol: float, width: float | None,
            ties: Sequence[str] = (), name: str = "run") -> DataFrame:
    """Numbers groups of intervals: a new one where a start lies past every earlier end by more than ``tol``."""
    bucket, order = ranged(start, width), [start, end, *ties]
    d = running(df, keys, bucket, order, {"_end": ("max", F.col(end))}, inclusive=False)
    new = F.when(F.col("_end").isNull() | (F.col(start) > F.col("_end") + tol), 1).otherwise(0)
    return running(d.withColumn("_new", new), keys, bucket, order, {name: ("sum", F.col("_new"))}).drop("_end", "_new")


def anchored(df: DataFrame, keys: Sequence[str], value: str, tol: float, width: float | None) -> DataFrame:
    """Adds the first value of each row's cluster: a new one starts when value - first > ``tol``.

    A gap above ``tol`` always starts a cluster, so each chained run is folded alone,
    and over its distinct values only. Without a width no join follows: each row carries its run.
    """
    keys = list(keys)
    if width is None:
        held = F.array_sort(F.collect_set(value).over(W.partitionBy(*keys, "_run")))
        d = chained(df, keys, value, value, tol, None, name="_run").withColumn("_v", held).withColumn("_v", _firsts(tol))
        return d.withColumn("cluster", F.array_max(F.filter("_v", lambda a: a <= F.col(value)))).drop("_run", "_v")
    # Read by the fold and by the naming join, so the numbered distinct values are written once.
    runs = cut(chained(df.select(*keys, value).distinct(), keys, value, value, tol, width, name="_run"))
    firsts = (runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_set(value)).alias("_v"))
              .withColumn("_v", _firsts(tol)))
    first = F.array_max(F.filter("_v", lambda a: a <= F.col(value)))
    named = runs.join(firsts, [*keys, "_run"]).select(*keys, value, first.alias("cluster"))
    return df.join(named, [*keys, value])


def _firsts(tol: float) -> Column:
    """First value of each cluster of the sorted values ``_v``."""
    return F.aggregate("_v", F.slice("_v", 1, 1), lambda a, v: F.when(v - F.element_at(a, -1) > tol, F.concat(a, F.array(v))).otherwise(a))


def mean_lines(df: DataFrame, keys: Sequence[str], value: str, tol: float, width: float) -> DataFrame:
    """Adds the number of each row's line: a row joins while it is within ``tol`` of the line's mean.

    The mean never passes the last value, so gaps above ``tol`` cut the fold; equal
    values always share a line, so it runs over (value, count).
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    runs = cut(chained(counts, keys, value, value, tol, width, name="_run"))

    def step(s: Column, v: Column) -> Column:
        joins = F.abs(s.total / s.n - v.v) <= tol
        return F.struct(
            F.when(joins, s.firsts).otherwise(F.concat(s.firsts, F.array(v.v))).alias("firsts"),
            F.when(joins, s.total).otherwise(0.0).__add__(v.v * v.n).alias("total"),
            (F.when(joins, s.n).otherwise(0) + v.n).alias("n"))

    seq = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("_n").alias("n"))))
    start = F.struct(F.array().cast("array<double>").alias("firsts"), F.lit(float("inf")).alias("total"), F.lit(1).cast("bigint").alias("n"))
    firsts = runs.groupBy(*keys, "_run").agg(seq.alias("_s")).withColumn(
        "_f", F.aggregate("_s", start, step, lambda s: s.firsts)).drop("_s")
    named = runs.join(firsts, [*keys, "_run"]).select(
        *keys, value, F.array_max(F.filter("_f", lambda a: a <= F.col(value))).alias("line_start"))
    return df.join(named, [*keys, value])


def coverage(df: DataFrame, keys: Sequence[str], start: str, end: str, lo: Column, hi: Column, width: float | None) -> DataFrame:
    """Union length per key of intervals clipped to [lo, hi]."""
    clipped = (df.filter((F.col(end) > lo) & (F.col(start) < hi))
               .select(*keys, F.greatest(F.col(start), lo).alias("_a"), F.least(F.col(end), hi).alias("_b")).distinct())
    d = running(clipped, keys, ranged("_a", width), ["_a", "_b"], {"_seen": ("max", F.col("_b"))}, inclusive=False)
    gain = F.greatest(F.col("_b") - F.greatest(F.col("_a"), F.coalesce("_seen", "_a")), F.lit(0.0))
    return d.groupBy(*keys).agg(F.sum(gain).alias("covered"))


def gaps(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Distinct values per key with the gap to the one before (null for the first)."""
    d = running(df.select(*keys, value).distinct(), keys, F.floor(F.col(value) / width), [value],
                {"_prev": ("last", F.col(value))}, inclusive=False)
    return d.withColumn("gap", F.col(value) - F.col("_prev")).drop("_prev")


def pitch_runs(df: DataFrame, keys: Sequence[str], value: str, factor: float, width: float) -> DataFrame:
    """Values numbered into runs cut where a gap exceeds ``factor`` times the key's upper-median gap."""
    g = gaps(df, keys, value, width)
    pitch = g.groupBy(*keys).agg(upper_median("gap").alias("pitch"))
    cut = F.when(F.col("gap") > F.col("pitch") * factor, 1).otherwise(0)
    return running(g.join(pitch, list(keys)).withColumn("_cut", cut), keys, F.floor(F.col(value) / width), [value],
                   {"run": ("sum", F.col("_cut"))}).drop("_cut")


def longest_run(df: DataFrame, keys: Sequence[str], value: str, factor: float, width: float) -> DataFrame:
    """The longest evenly pitched run per key (first on a tie)."""
    runs = pitch_runs(df, keys, value, factor, width).groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("rows"), F.min(value).alias("top"), F.max(value).alias("bottom"), F.first("pitch").alias("pitch"))
    best = F.max_by(F.struct("rows", "top", "bottom", "pitch"), F.struct("rows", -F.col("run")))
    return runs.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def densest(df: DataFrame, keys: Sequence[str], value: str, span: float) -> DataFrame:
    """Largest number of rows within ``span`` of one another and where that run starts.

    Runs over distinct positions with counts. Each position is also handed to the
    next range bucket, so no window spans a whole key.
    """
    width = max(span * 64, 1.0)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    home = F.floor(F.col(value) / width)
    halo = F.array_distinct(F.array(home, F.floor((F.col(value) + span) / width)))
    spread = counts.select("*", home.alias("_home"), F.explode(halo).alias("_b"))
    w = W.partitionBy(*keys, "_b").orderBy(value).rangeBetween(-int(span), 0)
    at = spread.select(*keys, value, "_home", "_b", F.sum("n").over(w).alias("run"), F.min(value).over(w).alias("left"))
    best = F.max_by(F.struct("run", "left"), F.struct("run", -F.col(value)))
    return at.filter("_home = _b").groupBy(*keys).agg(best.alias("r")).select(*keys, "r.run", "r.left")


def histogram_spans(df: DataFrame, keys: Sequence[str], start: str, end: str, stray: DataFrame, width: float) -> DataFrame:
    """x spans covered by more than ``stray`` intervals of the key, from a sweep of +1 / -1 edges.

    ``stray`` has the keys and a column ``stray``.
    """
    keys = list(keys)
    edges = (df.select(*keys, F.explode(F.array(
        F.struct(F.floor(start).alias("x"), F.lit(1).alias("d")),
        F.struct((F.floor(end) + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*keys, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d")))
    bucket = F.floor(F.col("x") / width)
    covered = running(edges, keys, bucket, ["x"], {"n": ("sum", F.col("d"))}).join(stray, keys)
    covered = covered.withColumn("above", F.col("n") > F.col("stray"))
    turns = (running(covered, keys, bucket, ["x"], {"was": ("last", F.col("above"))}, inclusive=False)
             .filter(F.col("above") != F.coalesce("was", F.lit(False))))
    numbered = running(turns, keys, bucket, ["x"], {"k": ("sum", F.col("above").cast("int"))})
    return numbered.groupBy(*keys, "k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).drop("k")
