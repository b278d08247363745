"""Joins by nearness on a page, keyed by grid cell.

One side sits in exactly one cell, the other is listed in every cell within
reach, so a pair meets once and the cell spreads a crowded page over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _span(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(_cell(lo, size), _cell(hi, size))


def points_near(points: DataFrame, others: DataFrame, keys: Sequence[str], reach_x: float, reach_y: float | None = None,
                at: tuple[str, str] = ("cx", "cy"), other: tuple[str, str] = ("ox", "oy"), cells: int = 1, how: str = "inner") -> DataFrame:
    """Pairs of points with |dx| <= reach_x and |dy| <= reach_y on the same keys.

    A cell is ``cells`` reaches wide: an other is listed in (1 + 2 / cells)^2 cells in the mean, and a point compared with
    what lies in (cells + 2)^2 squares of a reach. ``how="left"`` keeps the points that nothing is near.
    """
    ry = reach_y if reach_y is not None else reach_x
    wx, wy = reach_x * cells, ry * cells
    a = points.withColumn("_gx", _cell(F.col(at[0]), wx)).withColumn("_gy", _cell(F.col(at[1]), wy))
    b = (others.withColumn("_gx", F.explode(_span(F.col(other[0]) - reach_x, F.col(other[0]) + reach_x, wx)))
         .withColumn("_gy", F.explode(_span(F.col(other[1]) - ry, F.col(other[1]) + ry, wy))))
    names = [*keys, "_gx", "_gy"]
    b = b.select([F.col(c).alias(f"_of_{c}") if c in names else F.col(c) for c in b.columns])
    on = [F.col(c) == F.col(f"_of_{c}") for c in names]
    near = (F.abs(F.col(at[0]) - F.col(other[0])) <= reach_x) & (F.abs(F.col(at[1]) - F.col(other[1])) <= ry)
    return a.join(b, reduce(Column.__and__, on, near), how).drop("_gx", "_gy", *[f"_of_{c}" for c in names])


def reach_of(points: DataFrame, others: DataFrame, keys: Sequence[str], k: int, far: float, finest: int = -4,
             at: tuple[str, str] = ("cx", "cy"), other: tuple[str, str] = ("ox", "oy")) -> DataFrame:
    """Adds ``_far``: a distance within which a point has its ``k`` nearest others, ``far`` at most.

    Squares of 2^l hold counted others; of those a point lies in, the smallest with ``k`` of them has none farther than its
    diagonal. Crowded places so look a short way, and what is compared grows with the rows, not with their square.
    """
    keys = list(keys)
    levels = F.explode(F.sequence(F.lit(finest), F.lit(math.floor(math.log2(far / math.sqrt(2))))))
    square = lambda df, x, y: df.withColumn("_lv", levels).withColumn("_size", F.pow(F.lit(2.0), F.col("_lv"))).select(
        *df.columns, "_lv", _cell(F.col(x), F.col("_size")).alias("_gx"), _cell(F.col(y), F.col("_size")).alias("_gy"))
    full = square(others.select(*keys, *other), *other).groupBy(*keys, "_lv", "_gx", "_gy").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    spots = square(points.select(*keys, *at).distinct(), *at).join(full, [*keys, "_lv", "_gx", "_gy"])
    near = spots.groupBy(*keys, *at).agg((F.pow(F.lit(2.0), F.min("_lv")) * 1.4143).alias("_d"))
    return points.join(near, [*keys, *at], "left").select(*points.columns, F.least(F.coalesce("_d", F.lit(far)), F.lit(far)).alias("_far"))


def points_within_own_reach(points: DataFrame, others: DataFrame, keys: Sequence[str], reach: Column,
                            at: tuple[str, str] = ("cx", "cy"), other: tuple[str, str] = ("ox", "oy")) -> DataFrame:
    """Pairs with |dx| and |dy| up to the point's own ``reach`` on the same keys.

    A point is listed in the cells around it on the level its reach calls for (cells of 2^l, at most three by three),
    an other in one cell of every level its key has.
    """
    a = points.withColumn("_r", reach).withColumn("_lv", F.ceil(F.log2(F.greatest(F.col("_r"), F.lit(1 / 16)))).cast("int"))
    size = F.pow(F.lit(2.0), F.col("_lv"))
    levels = a.select(*keys, "_lv").distinct()
    a = (a.withColumn("_gx", F.explode(_span(F.col(at[0]) - F.col("_r"), F.col(at[0]) + F.col("_r"), size)))
         .withColumn("_gy", F.explode(_span(F.col(at[1]) - F.col("_r"), F.col(at[1]) + F.col("_r"), size))))
    b = others.join(levels, list(keys)).withColumn("_gx", _cell(F.col(other[0]), size)).withColumn("_gy", _cell(F.col(other[1]), size))
    near = (F.abs(F.col(at[0]) - F.col(other[0])) <= F.col("_r")) & (F.abs(F.col(at[1]) - F.col(other[1])) <= F.col("_r"))
    return a.join(b, [*keys, "_lv", "_gx", "_gy"]).filter(near).drop("_lv", "_gx", "_gy", "_r")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """(point, interval) pairs with lo <= at <= hi on the same keys.

    Cells are as wide as the interval: one of length 2^l to 2^(l+1) is listed in the two or three cells of level l + 1 it
    touches, a point in one cell of each level its key has. A long interval is so listed no oftener than a short one.
    """
    level = F.floor(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1.0)))).cast("int") + 1
    b = intervals.filter(F.col(hi) >= F.col(lo)).withColumn("_lv", level)
    size = F.pow(F.lit(2.0), F.col("_lv"))
    levels = b.select(*keys, "_lv").distinct()
    b = b.withColumn("_gx", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))
    a = points.join(levels, list(keys)).withColumn("_gx", F.floor(F.col(at) / size))
    return a.join(b, [*keys, "_lv", "_gx"]).drop("_lv", "_gx").filter(F.col(at).between(F.col(lo), F.col(hi)))


def points_in_reach_of_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str], reach: float, cell: float,
                             at: tuple[str, str] = ("px", "py"), cell_y: float | None = None) -> DataFrame:
    """(point, box) pairs whose gap, zero inside the box, is at most ``reach``; adds ``gap``. ``cell_y`` makes low cells for low boxes."""
    tall = cell if cell_y is None else cell_y
    p = points.withColumn("_gx", _cell(F.col(at[0]), cell)).withColumn("_gy", _cell(F.col(at[1]), tall))
    b = (boxes.withColumn("_gx", F.explode(_span(F.col("x0") - reach, F.col("x1") + reach, cell)))
         .withColumn("_gy", F.explode(_span(F.col("y0") - reach, F.col("y1") + reach, tall))))
    x, y = F.col(at[0]), F.col(at[1])
    dx = F.greatest(F.col("x0") - x, F.lit(0.0), x - F.col("x1"))
    dy = F.greatest(F.col("y0") - y, F.lit(0.0), y - F.col("y1"))
    return p.join(b, [*keys, "_gx", "_gy"]).drop("_gx", "_gy").withColumn("gap", F.sqrt(dx * dx + dy * dy)).filter(F.col("gap") <= reach)


def boxes_overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Pairs of boxes overlapping strictly on both axes; ``b`` carries bx0..by1.

    Both sides are listed per cell; a pair counts in the first cell both reach.
    """
    left = (a.withColumn("_gx", F.explode(_span(F.col("x0"), F.col("x1"), cell)))
            .withColumn("_gy", F.explode(_span(F.col("y0"), F.col("y1"), cell))))
    right = (b.withColumn("_gx", F.explode(_span(F.col("bx0"), F.col("bx1"), cell)))
             .withColumn("_gy", F.explode(_span(F.col("by0"), F.col("by1"), cell))))
    home = ((F.col("_gx") == F.greatest(_cell(F.col("x0"), cell), _cell(F.col("bx0"), cell)))
            & (F.col("_gy") == F.greatest(_cell(F.col("y0"), cell), _cell(F.col("by0"), cell))))
    hit = (F.col("x0") < F.col("bx1")) & (F.col("bx0") < F.col("x1")) & (F.col("y0") < F.col("by1")) & (F.col("by0") < F.col("y1"))
    return left.join(right, [*keys, "_gx", "_gy"]).filter(home & hit).drop("_gx", "_gy")


def as_other(df: DataFrame, keys: Sequence[str], prefix: str = "b") -> DataFrame:
    """Every non-key column renamed with a prefix, ready to be the other side of a pair."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)
