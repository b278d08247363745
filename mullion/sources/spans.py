"""Page spans and rulings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def text_items(spans: DataFrame) -> DataFrame:
    """Spans trimmed, blanks dropped, and a run printed twice at one spot (half a point) kept once.

    ``spans(doc, page, pos, x0..y1, text, size, horizontal)``; the earlier ``pos`` wins. Few spans are printed twice, so nothing
    is folded before the shuffle; it is dealt by page, where neighbouring rows are alike and pack well.
    """
    t = spans.withColumn("text", F.trim("text")).filter("text <> ''")
    t = t.select("doc", "page", "pos", "x0", "y0", "x1", "y1", "text", "size", "horizontal").repartition("doc", "page")
    spot = [F.col("doc"), F.col("page"), F.bround(F.col("x0") * 2, 0), F.bround(F.col("y0") * 2, 0), F.col("text")]
    first = t.withColumn("_rn", F.row_number().over(Window.partitionBy(*spot).orderBy("pos"))).filter("_rn = 1")
    return first.select("doc", "page", "x0", "y0", "x1", "y1", "text", "size", "horizontal")


def rulings(segments: DataFrame, straight: float = 0.8, shortest: float = 2.0) -> DataFrame:
    """Axis-aligned segments as rulings: axis, position, start and end."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    axis = F.when(dy <= straight, "h").when(dx <= straight, "v")
    lie = axis == "h"
    r = segments.select("doc", "page", axis.alias("axis"), F.when(lie, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).alias("pos"),
                        F.when(lie, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("start"), F.when(lie, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("end"))
    return r.filter("axis IS NOT NULL").withColumn("length", F.col("end") - F.col("start")).filter(F.col("length") >= shortest)
