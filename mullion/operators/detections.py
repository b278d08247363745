"""Detected doors: duplicates, primaries, suppression, assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mullion.operators import graph
from mullion.operators.overlay import earliest
from mullion.operators.spatial import as_other, boxes_overlapping, hypot, points_in_reach_of_boxes, points_near, points_within_own_reach, reach_of
from mullion.runtime import cut


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def drop_near(det: DataFrame, keys: Sequence[str], distance: float) -> DataFrame:
    """Near-duplicates dropped, best confidence first: one within ``distance`` of a kept one goes."""
    ranked = det.withColumn("_rank", F.struct(confidence_rank(F.col("confidence")).alias("c"), "id"))
    other = as_other(ranked.select(*keys, "id", "cx", "cy", "_rank"), keys)
    pairs = points_near(ranked, other, keys, distance, other=("bcx", "bcy")).filter(
        (F.col("b_rank") < F.col("_rank")) & (hypot(F.col("cx") - F.col("bcx"), F.col("cy") - F.col("bcy")) <= distance))
    kept = graph.first_fit(det.select("id"), pairs.select("id", F.col("bid").alias("rival")))
    return det.join(kept, "id", "left_semi")


def one_per_door(det: DataFrame, keys: Sequence[str], cell: float = 64.0) -> DataFrame:
    """One detection per tag (geometry, then confidence); untagged ones only where nothing kept overlaps them."""
    order = [(~F.col("has_arc")).cast("int"), confidence_rank(F.col("confidence")), F.col("id")]
    tagged = earliest(det.filter("tag <> ''"), [*keys, "tag"], order).select(*det.columns)
    loose = det.filter("tag = ''")
    hit = boxes_overlapping(loose, as_other(tagged.select(*keys, "x0", "y0", "x1", "y1"), keys), keys, cell).select("id").distinct()
    free = loose.join(hit, "id", "left_anti")
    rivals = boxes_overlapping(free, as_other(free.select(*keys, "id", "x0", "y0", "x1", "y1"), keys), keys, cell).filter("bid < id")
    kept = graph.first_fit(free.select("id"), rivals.select("id", F.col("bid").alias("rival")))
    return tagged.unionByName(free.join(kept, "id", "left_semi").select(*det.columns))


def assign(boxes: DataFrame, tags: DataFrame, keys: Sequence[str], window: float = 85.0, bonus: float = 2.0) -> DataFrame:
    """Mutual-nearest numbers for boxes: kept only where box and tag are each other's closest.

    ``boxes(id, read, x0..y1)``, ``tags(tag, px, py)``. The window tests the raw
    gap; the ranking takes ``bonus`` off where the number read equals the tag.
    """
    pairs = points_in_reach_of_boxes(tags, boxes, keys, window, window)
    cost = F.col("gap") - F.when(F.col("tag") == F.col("read"), bonus).otherwise(0.0)
    pairs = pairs.withColumn("cost", cost)
    near = pairs.groupBy(*keys, "id").agg(F.min_by(F.struct("tag", "gap"), F.struct("cost", "tag")).alias("b"))
    claimed = pairs.groupBy(*keys, "tag").agg(F.min_by("id", F.struct("cost", "id")).alias("id"))
    return near.select(*keys, "id", "b.tag", "b.gap").join(claimed, [*keys, "tag", "id"], "left_semi")


def nearest_owner(arcs: DataFrame, points: DataFrame, keys: Sequence[str], door_pt: float, sweep: float = 6.0) -> DataFrame:
    """Each arc goes to its nearest point, each point keeps its nearest arc, and the page's outliers go.

    ``arcs(arc, cx, cy)``, ``points(point, ox, oy)``. With four or more kept, a gap above
    three times the page's lower quartile (at least one door width) is dropped.
    """
    from mullion.operators import sequence as seq

    reach = door_pt * sweep
    gap = hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"))
    pairs = points_near(arcs, points, keys, reach).withColumn("gap", gap).filter(F.col("gap") <= reach)
    owner = pairs.groupBy(*keys, "arc").agg(F.min_by(F.struct("point", "gap"), F.struct("gap", "point")).alias("o")).select(*keys, "arc", "o.*")
    kept = owner.groupBy(*keys, "point").agg(F.min_by(F.struct("arc", "gap"), F.struct("gap", "arc")).alias("o")).select(*keys, "point", "o.*")
    habit = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), seq.lower_quartile("gap").alias("_q"))
    limit = F.greatest(F.col("_q") * 3, F.lit(door_pt))
    return kept.join(habit, list(keys)).filter((F.col("_n") < 4) | (F.col("gap") <= limit)).drop("_n", "_q")


def choose_wall(doors: DataFrame, tags: DataFrame, keys: Sequence[str], door_pt: float, reach: float = 20.0, decisive: float = 1.6) -> DataFrame:
    """Nearest wall tag per door, or the shortlist when another symbol among the next three is nearly as near."""
    from mullion.operators.ranking import smallest

    far = door_pt * reach
    gap = hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"))
    # Of tags on one spot only the first four can be among a door's four; a door looks no farther than four of them are sure to be.
    tags = smallest(tags, [*keys, "ox", "oy"], [F.col("symbol"), F.col("tag_id")], 4).drop("rn")
    doors = cut(reach_of(doors, tags, keys, 4, far))
    pairs = points_within_own_reach(doors, tags, keys, F.col("_far")).drop("_far").withColumn("gap", gap).filter(F.col("gap") <= far)
    top = smallest(pairs, [*keys, "id"], [F.col("gap"), F.col("symbol"), F.col("tag_id")], 4)
    near = top.groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("rn", "gap", "symbol"))).alias("r"))
    first = F.get("r", F.lit(0))
    rivals = F.transform(F.filter(F.slice("r", 2, 3), lambda s: (s.symbol != first.symbol) & (s.gap <= first.gap * decisive)), lambda s: s.symbol)
    return near.select(*keys, "id", (F.size(rivals) == 0).alias("decided"), first.gap.alias("gap"),
                       F.slice(F.array_distinct(F.concat(F.array(first.symbol), rivals)), 1, 3).alias("candidates"))


def suppress(det: DataFrame, dead: DataFrame, keys: Sequence[str], cell: float, share: float = 0.5) -> DataFrame:
    """Detections no tombstone covers: tagged by number, untagged by nearness (half the wider box), never across.

    Each box looks as far as its own width says; ``cell`` only spreads a page over tasks.
    """
    keys = list(keys)
    by_tag = dead.filter("tag <> ''").select(*keys, "tag").distinct()
    left = det.join(by_tag, [*keys, "tag"], "left_anti")
    reach = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6)) * share

    def spots(df: DataFrame, *name: str) -> tuple[DataFrame, DataFrame]:
        d = df.filter("tag = ''").select(*keys, *name, "cx", "cy", reach.alias("r")).withColumn("_w", F.col("r") * (1 + 1e-9) + 1e-9)
        return (d.select(*keys, *name, F.col("cx").alias("px"), F.col("cy").alias("py")),
                d.select(*keys, *name, F.col("cx").alias("mx"), F.col("cy").alias("my"), "r", (F.col("cx") - F.col("_w")).alias("x0"), (F.col("cx") + F.col("_w")).alias("x1"),
                         (F.col("cy") - F.col("_w")).alias("y0"), (F.col("cy") + F.col("_w")).alias("y1")))

    (points, boxes), (dead_points, dead_boxes) = spots(left, "id"), spots(dead)
    near = [points_in_reach_of_boxes(p, b, keys, 0.0, cell).filter(hypot(F.col("px") - F.col("mx"), F.col("py") - F.col("my")) <= F.col("r")).select("id")
            for p, b in ((dead_points, boxes), (points, dead_boxes))]
    return left.join(near[0].union(near[1]).distinct(), "id", "left_anti")


def keep_types(new: DataFrame, typed: DataFrame, keys: Sequence[str], page: str, reach: float) -> DataFrame:
    """Types set by hand carried to rebuilt rows: by tag, else to untagged rows by both centre offsets."""
    on = list(dict.fromkeys([*keys, page]))  # a page among the keys is one column
    by_tag = typed.filter("tag <> ''").groupBy(*keys, "tag").agg(F.max_by("kind", "typed_id").alias("_by_tag"))
    loose = typed.filter("tag = ''").select(*on, F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("kind").alias("_k"), "typed_id")
    hits = (points_near(new.filter("tag = ''").select(*on, "id", "cx", "cy"), loose, on, reach)
            .groupBy("id").agg(F.min_by("_k", "typed_id").alias("_near")))
    return (new.join(by_tag, [*keys, "tag"], "left").join(hits, "id", "left")
            .withColumn("kind", F.coalesce("_by_tag", "_near", "kind"))
            .withColumn("kind_by_hand", F.coalesce("_by_tag", "_near").isNotNull()).drop("_by_tag", "_near"))


def in_region(det: DataFrame, regions: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Detections whose box centre lies in any region of their page (edges included)."""
    hit = points_in_reach_of_boxes(det.select(*keys, "id", F.col("cx").alias("px"), F.col("cy").alias("py")),
                                   regions.select(*keys, "x0", "y0", "x1", "y1"), keys, 0.0, cell)
    return det.join(hit.select("id").distinct(), "id", "left_semi")


def counted_on(det: DataFrame, sheets: DataFrame) -> DataFrame:
    """Name of the sheet of the latest primary row with the same tag, '' when none (a blank tag is a tag too)."""
    named = det.join(sheets, "sheet_id", "left")
    primary = named.filter("is_primary").groupBy("tag").agg(F.max_by(F.coalesce("number", F.lit("")), "id").alias("counted_on"))
    return named.join(primary, "tag", "left").withColumn("counted_on", F.coalesce("counted_on", F.lit("")))


def calibrate(arcs: DataFrame, points: DataFrame, keys: Sequence[str], reach: float, sample: int | None = None) -> DataFrame:
    """Door radius per sheet: the largest half-point bucket explaining 80 % of what the best one does.

    All points of a sheet count, or its first ``sample``.
    """
    from mullion.operators.ranking import smallest

    chosen = points if sample is None else smallest(points, keys, [F.col("point")], sample).drop("rn")
    seen = points_near(arcs, chosen, keys, reach).withColumn("r", F.bround(F.col("radius") * 2, 0) / 2)
    covers = seen.groupBy(*keys, "r").agg(F.countDistinct("point").alias("doors")).filter("r >= 3")
    best = covers.groupBy(*keys).agg(F.max("doors").alias("best")).filter("best >= 3")
    return covers.join(best, list(keys)).filter("doors >= best * 0.8").groupBy(*keys).agg(F.max("r").alias("radius"), F.max("best").alias("doors"))


def fit_circles(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kasa circle fit per chain from grouped moments: centre, mean radius, rms residual, span."""
    mean = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = points.join(mean, list(keys)).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    u, v = F.col("u"), F.col("v")
    m = c.groupBy(*keys, "mx", "my").agg(
        F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * u * u).alias("uuu"),
        F.sum(v * v * v).alias("vvv"), F.sum(u * v * v).alias("uvv"), F.sum(v * u * u).alias("vuu"), F.count(F.lit(1)).alias("n"))
    det = 2 * (F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"))
    su, sv = F.col("uuu") + F.col("uvv"), F.col("vvv") + F.col("vuu")
    centre = m.filter(F.abs(det) >= 1e-9).select(
        *keys, "n", ((su * F.col("vv") - sv * F.col("uv")) / det + F.col("mx")).alias("cx"),
        ((sv * F.col("uu") - su * F.col("uv")) / det + F.col("my")).alias("cy"))
    r = points.join(centre, list(keys)).withColumn("r", hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).withColumn(
        "deg", F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))))
    return r.groupBy(*keys, "n", "cx", "cy").agg(
        F.avg("r").alias("radius"), F.sqrt(F.greatest(F.avg(F.col("r") * F.col("r")) - F.avg("r") * F.avg("r"), F.lit(0.0))).alias("residual"),
        F.min("deg").alias("start_deg"), F.max("deg").alias("end_deg"))


def is_arc(expected: Column, most_residual: float = 0.08, tolerance: float = 0.45) -> Column:
    """Whether a fitted chain is a door's swing: four points or more close to the circle, an eighth to three eighths of
    a turn, and a radius near ``expected`` (null: any)."""
    span = F.col("end_deg") - F.col("start_deg")
    sized = F.coalesce(F.abs(F.col("radius") - expected) <= expected * tolerance, F.lit(True))
    return (F.col("n") >= 4) & (F.col("residual") <= most_residual) & (F.col("radius") > 0) & span.between(45, 135) & sized


def accept_arcs(fits: DataFrame, expected: Column, most_residual: float = 0.08, tolerance: float = 0.45) -> DataFrame:
    return fits.filter(is_arc(expected, most_residual, tolerance))


def confirm(det: DataFrame, arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sightings left once those far from an opening and those drawn otherwise are dropped, with ``shown``.

    ``det(keys, id, tag, shape, beside)``, ``arcs(keys, id)`` the sightings with an accepted arc. A sighting is vouched for by
    its tag or by such an arc; the others are withheld.
    """
    kept = drop_wrong_shape(drop_far(det, keys), keys)
    fitted = arcs.select(*keys, "id").distinct().withColumn("_arc", F.lit(True))
    return kept.join(fitted, [*keys, "id"], "left").withColumn("shown", (F.coalesce("tag", F.lit("")) != "") | F.col("_arc").isNotNull()).drop("_arc")


def drop_far(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A tag seen beside an opening anywhere loses its sightings that are not beside one."""
    beside = det.filter("beside AND tag <> ''").select(*keys, "tag").distinct().withColumn("_b", F.lit(True))
    return det.join(beside, [*keys, "tag"], "left").filter("beside OR _b IS NULL").drop("_b")


def usual_shape(det: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """Most common enclosure shape per document (first seen on a tie), where at least ``least`` carry it."""
    n = det.filter("shape <> ''").groupBy(*keys, "shape").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    top = n.groupBy(*keys).agg(F.max_by(F.struct("shape", "n"), F.struct("n", -F.col("first"))).alias("t"))
    return top.select(*keys, "t.*").filter(F.col("n") >= least)


def drop_wrong_shape(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sightings drawn otherwise go where the same tag is drawn in the usual shape."""
    usual = usual_shape(det, keys).select(*keys, F.col("shape").alias("_usual"))
    proper = det.filter("tag <> ''").join(usual, list(keys)).filter("shape = _usual").select(*keys, "tag").distinct().withColumn("_p", F.lit(True))
    return (det.join(usual, list(keys), "left").join(proper, [*keys, "tag"], "left")
            .filter("_usual IS NULL OR shape = _usual OR _p IS NULL").drop("_usual", "_p"))


def swing_kind(leaves: Column, width_ft: Column, per_foot: Column, radius: Column) -> Column:
    known = (F.coalesce(width_ft, F.lit(0.0)) != 0) & (F.coalesce(per_foot, F.lit(0.0)) != 0)
    double = F.when(known, width_ft * per_foot >= radius * 1.5).otherwise(leaves >= 2)
    return F.when(double, "double_swing").otherwise("single_swing")
