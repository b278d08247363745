"""Plan sheets: tags and their surroundings, leaves, leaders, regions, tiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mullion.functions import text
from mullion.operators import graph
from mullion.operators.spatial import as_other, boxes_overlapping, hypot, points_near, points_within_own_reach
from mullion.runtime import small

# Fixed value: what a sheet number looks like.
SHEET_RE = r"^[A-Z]{1,3}[-.]?\d{1,3}([-.]\d{1,3})?[A-Za-z]?$"


def upright(items: DataFrame) -> DataFrame:
    """Sideways text re-based onto its row, so every item is part of a printed line."""
    return items.withColumn("y0", F.when(F.col("horizontal"), F.col("y0")).otherwise(F.col("y1") - (F.col("x1") - F.col("x0")))).withColumn(
        "horizontal", F.lit(True))


def pieces(spans: DataFrame, keys: Sequence[str], small: float = 0.75, tall: float = 2.0) -> DataFrame:
    """Spans without footnote marks and tall text, by the page's median size and height."""
    usual = spans.groupBy(*keys).agg(F.median("size").alias("_s"), F.median(F.col("y1") - F.col("y0")).alias("_h"))
    return spans.join(usual, list(keys)).filter((F.col("size") >= F.col("_s") * small) & (F.col("y1") - F.col("y0") <= F.col("_h") * tall)).drop("_s", "_h")


def outside(items: DataFrame, boxes: DataFrame, keys: Sequence[str], cell: float = 256.0) -> DataFrame:
    """Items not wholly inside any box (``bx0..by1``) of their page.

    A box around an item has its upper left corner, so an item is looked up in the cell of that corner alone and moved once.
    """
    at = items.withColumn("_gx", F.floor(F.col("x0") / cell)).withColumn("_gy", F.floor(F.col("y0") / cell))
    held = (boxes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "bx0", "by0", "bx1", "by1")
            .withColumn("_of_gx", F.explode(F.sequence(F.floor(F.col("bx0") / cell), F.floor(F.col("bx1") / cell))))
            .withColumn("_of_gy", F.explode(F.sequence(F.floor(F.col("by0") / cell), F.floor(F.col("by1") / cell)))))
    on = [at[k] == held[f"_of_{k}"] for k in keys] + [at["_gx"] == held["_of_gx"], at["_gy"] == held["_of_gy"]]
    hit = (F.col("x0") < F.col("bx1")) & (F.col("bx0") < F.col("x1")) & (F.col("y0") < F.col("by1")) & (F.col("by0") < F.col("y1"))
    within = (F.col("bx0") <= F.col("x0")) & (F.col("x1") <= F.col("bx1")) & (F.col("by0") <= F.col("y0")) & (F.col("y1") <= F.col("by1"))
    return at.join(held, reduce(Column.__and__, on, hit & within), "left_anti").drop("_gx", "_gy")


def to_fraction(boxes: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes as fractions of their page; null where the page has no size."""
    j = boxes.join(small(sizes), list(keys), "left")
    return j.withColumns({"x0": F.try_divide("x0", "width"), "x1": F.try_divide("x1", "width"),
                          "y0": F.try_divide("y0", "height"), "y1": F.try_divide("y1", "height")}).drop("width", "height")


def company(items: DataFrame, keys: Sequence[str], rx: float = 45.0, ry: float = 28.0, of: str | None = None) -> DataFrame:
    """Score of each item's surroundings: +2 beside a tag, +1 beside a dimension.

    Only tags and dimensions are looked for, so only they are spread over cells (four reaches wide), and a cell's are listed once: an
    item meets the list of its own cell, and is moved once. ``of`` names the items to score, else all.
    """
    from mullion.operators.tables import let

    keys, wx, wy = list(keys), rx * 4, ry * 4
    cells = lambda v, r, w: F.explode(F.sequence(F.floor((F.col(v) - r) / w), F.floor((F.col(v) + r) / w)))
    others = items.filter("is_tag OR is_dim").withColumn("_gx", cells("cx", rx, wx)).withColumn("_gy", cells("cy", ry, wy))
    other = F.struct("cx", "cy", F.col("is_tag").cast("int").alias("t"), F.col("is_dim").cast("int").alias("d"), "item")
    listed = others.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_gx").alias("_of_gx"), F.col("_gy").alias("_of_gy")).agg(F.collect_list(other).alias("_o"))
    at = (items if of is None else items.filter(of)).withColumn("_gx", F.floor(F.col("cx") / wx)).withColumn("_gy", F.floor(F.col("cy") / wy))
    on = [F.col(k) == F.col(f"_of_{k}") for k in keys] + [F.col("_gx") == F.col("_of_gx"), F.col("_gy") == F.col("_of_gy")]
    beside = lambda o: (F.abs(F.col("cx") - o.cx) <= rx) & (F.abs(F.col("cy") - o.cy) <= ry) & (F.col("item") != o.item)
    best = lambda n: F.array_max(F.transform(n, lambda o: o.t)) * 2 + F.array_max(F.transform(n, lambda o: o.d))
    score = F.when(F.col("_o").isNotNull(), let(F.filter("_o", beside), best))
    met = at.join(listed, reduce(Column.__and__, on), "left").withColumn("_s", score)
    return met.withColumn("score", F.coalesce("_s", F.lit(0))).withColumn("near", F.col("_s").isNotNull()).drop("_s", "_o", "_gx", "_gy", *[f"_of_{k}" for k in keys], "_of_gx", "_of_gy")


def stack_flags(numbers: DataFrame, items: DataFrame, keys: Sequence[str], sx: float = 22.0, sy: float = 26.0) -> DataFrame:
    """Numbers with flags: ``room`` when a room name stands above, ``bubble`` when a sheet reference stands below.

    Only names and references are looked for, so only they are spread over cells; of their text no more than that is carried.
    """
    ref = F.col("text").rlike(SHEET_RE)
    name = (F.length("text") >= 3) & F.col("text").rlike(r"\p{L}") & ~(ref & F.contains("text", F.lit(".")))
    others = items.select(*keys, F.col("cx").alias("ox"), F.col("y0").alias("oy"), name.alias("name"), ref.alias("ref")).filter("name OR ref")
    placed = numbers.select(*keys, "item", "cx", "y0").dropna(subset=[*keys, "cx", "y0"])
    pairs = points_near(placed, others, keys, sx, sy, at=("cx", "y0"), cells=4, how="left")
    drop = F.col("y0") - F.col("oy")
    return pairs.groupBy(*keys, "item").agg(
        F.max(F.coalesce((drop > 0) & (drop <= sy) & F.col("name"), F.lit(False))).alias("room"),
        F.max(F.coalesce((drop < 0) & (drop >= -sy) & F.col("ref"), F.lit(False))).alias("bubble"))


def join_stacked(items: DataFrame, tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A number over one or two capitals read as one mark, where together they are a known tag.

    Number and letter must each be the other's nearest candidate. Adds ``merged``.
    """
    keys = list(keys)
    cols = ["x0", "y0", "x1", "y1", "text", "size"]
    spot = items.select(*keys, *cols, F.struct(*cols).alias("me"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    letters = spot.filter("text RLIKE '^[A-Z]{1,2}$'").select(*keys, F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("me").alias("letter"))
    numbers = spot.filter("text RLIKE '^[0-9]+$'").select(*keys, "cx", "cy", F.col("me").alias("number"))
    height = F.greatest(F.col("number.size"), F.col("number.y1") - F.col("number.y0"), F.lit(1e-6))
    width = F.greatest(F.col("number.x1") - F.col("number.x0"), height)
    drop = F.col("oy") - F.col("cy")
    # A letter stands at most 1.7 heights below its number and 0.6 widths beside it.
    pairs = points_within_own_reach(numbers, letters, keys, F.greatest(height * 1.7, width * 0.6)).filter(
        (drop > 0) & (drop <= height * 1.7) & (F.abs(F.col("ox") - F.col("cx")) <= width * 0.6)
        & (F.abs(F.col("letter.size") - F.col("number.size")) <= F.col("number.size") * 0.25)).withColumn("drop", drop)
    known = pairs.withColumn("tag", F.concat("number.text", "letter.text")).join(tags.select("tag").distinct(), "tag", "left_semi")
    for_number = known.groupBy(*keys, "number").agg(F.min_by(F.struct("letter", "tag"), F.struct("drop", "letter")).alias("b")).select(*keys, "number", "b.letter", "b.tag")
    for_letter = known.groupBy(*keys, "letter").agg(F.min_by("number", F.struct("drop", "number")).alias("number"))
    won = for_number.join(for_letter, [*keys, "letter", "number"], "left_semi")
    merged = won.select(*keys, F.least("number.x0", "letter.x0").alias("x0"), F.col("number.y0").alias("y0"), F.greatest("number.x1", "letter.x1").alias("x1"),
                        F.col("letter.y1").alias("y1"), F.col("tag").alias("text"), F.col("number.size").alias("size"), F.lit(True).alias("merged"))
    used = won.select(*keys, F.col("number").alias("me")).unionByName(won.select(*keys, F.col("letter").alias("me")))
    rest = spot.join(used, [*keys, "me"], "left_anti").select(*keys, *cols, F.lit(False).alias("merged"))
    return rest.unionByName(merged)


def find_leaf(points: DataFrame, segs: DataFrame, keys: Sequence[str], door_pt: float) -> DataFrame:
    """Nearest straight leaf of a door: 0.55 to 1.35 door widths long, its middle within 1.2."""
    s = segs.select(*keys, F.col("id").alias("seg"), ((F.col("x0") + F.col("x1")) / 2).alias("ox"), ((F.col("y0") + F.col("y1")) / 2).alias("oy"),
                    hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("len")).filter(F.col("len").between(door_pt * 0.55, door_pt * 1.35))
    pairs = points_near(points, s, keys, door_pt * 1.2)
    gap = hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"))
    return pairs.groupBy(*keys, "point").agg(F.min_by(F.struct("seg", "len"), F.struct(gap, "seg")).alias("b")).select(*keys, "point", "b.*")


def leader_end(points: DataFrame, segs: DataFrame, keys: Sequence[str], door_pt: float) -> DataFrame:
    """Far end of the longest leader starting within a door width of the tag."""
    ends = segs.select(*keys, F.col("id").alias("seg"), F.explode(F.array(
        F.struct(F.col("x0").alias("ox"), F.col("y0").alias("oy"), F.col("x1").alias("bx"), F.col("y1").alias("by")),
        F.struct(F.col("x1").alias("ox"), F.col("y1").alias("oy"), F.col("x0").alias("bx"), F.col("y0").alias("by")))).alias("e")).select(*keys, "seg", "e.*")
    ends = ends.withColumn("len", hypot(F.col("bx") - F.col("ox"), F.col("by") - F.col("oy"))).filter(F.col("len") >= door_pt * 0.6)
    pairs = points_near(points, ends, keys, door_pt).filter(hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy")) <= door_pt)
    return pairs.groupBy(*keys, "point").agg(F.min_by(F.struct("bx", "by"), F.struct(-F.col("len"), "seg", "bx")).alias("b")).select(*keys, "point", "b.*")


def partners(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second leaf of a pair: radius within 20 %, hinges two radii apart within 30 %.

    Arcs meet in cells as wide as the first one's octave of radius asks, so arcs of any size find theirs.
    """
    keys = list(keys)
    real, cell = arcs.filter("radius > 0"), F.pow(F.lit(2.0), F.col("_o") + 1) * 2.3
    octave = lambda r, slack: F.floor(F.log2(r) + slack)
    a = real.withColumn("_o", octave(F.col("radius"), 0.0)).withColumns({"_gx": F.floor(F.col("cx") / cell), "_gy": F.floor(F.col("cy") / cell)})
    b = as_other(real, keys).withColumn("_o", F.explode(F.sequence(octave(F.col("bradius") / 1.2, -1e-9), octave(F.col("bradius") / 0.8, 1e-9))))
    for g, c in (("_gx", "bcx"), ("_gy", "bcy")):
        at = F.floor(F.col(c) / cell)
        b = b.withColumn(g, F.explode(F.sequence(at - 1, at + 1)))
    pairs = a.join(b, [*keys, "_o", "_gx", "_gy"]).filter("id <> bid")
    gap, r = hypot(F.col("cx") - F.col("bcx"), F.col("cy") - F.col("bcy")), F.col("radius")
    ok = (F.abs(F.col("bradius") - r) <= r * 0.2) & (F.abs(gap - r * 2) <= r * 0.3)
    return pairs.filter(ok).groupBy("id").agg(F.min("bid").alias("partner"))


def best_arc(points: DataFrame, arcs: DataFrame, keys: Sequence[str], reach: float, expected: float) -> DataFrame:
    """Best arc for a point: radius agreement, then residual, then distance."""
    off = F.abs(F.col("radius") - expected) / expected
    gap = hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"))
    return points_near(points, arcs, keys, reach).groupBy(*keys, "point").agg(F.min_by("arc", F.struct(off, "residual", gap, "arc")).alias("arc"))


def plan_extent(marks: DataFrame, walls: DataFrame, keys: Sequence[str], pad: float, long: float) -> DataFrame:
    """Box around the marks, grown by long walls clipped to a margin about them."""
    m = marks.groupBy(*keys).agg(F.min("cx").alias("mx0"), F.min("cy").alias("my0"), F.max("cx").alias("mx1"), F.max("cy").alias("my1"))
    w = walls.filter(hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= long).join(small(m), list(keys))
    lo_x, hi_x, lo_y, hi_y = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    near = (hi_x >= F.col("mx0") - pad) & (lo_x <= F.col("mx1") + pad) & (hi_y >= F.col("my0") - pad) & (lo_y <= F.col("my1") + pad)
    g = w.filter(near).groupBy(*keys).agg(
        F.min(F.greatest(lo_x, F.col("mx0") - pad)).alias("wx0"), F.min(F.greatest(lo_y, F.col("my0") - pad)).alias("wy0"),
        F.max(F.least(hi_x, F.col("mx1") + pad)).alias("wx1"), F.max(F.least(hi_y, F.col("my1") + pad)).alias("wy1"))
    j = m.join(g, list(keys), "left")
    return j.select(*keys, F.least("mx0", "wx0").alias("x0"), F.least("my0", "wy0").alias("y0"), F.greatest("mx1", "wx1").alias("x1"), F.greatest("my1", "wy1").alias("y1"))


def plan_tiles(regions: DataFrame, tile: float, overlap: float) -> DataFrame:
    """Overlapping tiles over each region."""
    step = tile - overlap
    n = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo) - overlap) / step), F.lit(1))
    grid = (regions.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n("x0", "x1") - 1)))
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), n("y0", "y1") - 1))))
    x, y = F.col("x0") + F.col("i") * step, F.col("y0") + F.col("j") * step
    return grid.withColumns({"tx0": x, "ty0": y, "tx1": F.least(x + tile, F.col("x1")), "ty1": F.least(y + tile, F.col("y1"))})


def tile_points(replies: DataFrame, tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tile-local points (a 0-1 or 0-1000 scale, inferred) as page-fraction boxes of the schedule's span."""
    top = F.greatest("a", "b")
    f = replies.withColumns({"fx": F.when(top <= 1, F.col("a")).otherwise(F.col("a") / 1000), "fy": F.when(top <= 1, F.col("b")).otherwise(F.col("b") / 1000)})
    f = f.filter(F.col("fx").between(0, 1) & F.col("fy").between(0, 1)).join(small(tiles), list(keys))
    cx = F.col("tx0") + F.col("fx") * (F.col("tx1") - F.col("tx0"))
    cy = F.col("ty0") + F.col("fy") * (F.col("ty1") - F.col("ty0"))
    half = F.col("span") / 2
    return f.withColumns({"x0": (cx - half) / F.col("width"), "y0": (cy - half) / F.col("height"), "x1": (cx + half) / F.col("width"), "y1": (cy + half) / F.col("height")})


def chains(segs: DataFrame, least: int = 4) -> DataFrame:
    """Segments joined at their ends into chains of four or more. ``segs(id, a, b)`` with end-point ids."""
    from mullion.operators import graph

    comp = graph.components(segs.select("a", "b"))
    lone = segs.join(comp.select(F.col("id").alias("a"), "component"), "a", "left").withColumn("chain", F.coalesce("component", "a"))
    n = lone.groupBy("chain").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("chain")
    return lone.join(n, "chain", "left_semi")


def assign_swings(points: DataFrame, arcs: DataFrame, keys: Sequence[str], reach: float, expected: float) -> DataFrame:
    """One arc per point, as many points served as possible: (point, arc).

    Points take their best arc (radius, distance, residual), the points with fewest choices first; the rest is matched by
    ``graph.widest_matching`` for all sheets together.
    """
    keys = list(keys)
    off = F.round(F.abs(F.col("radius") - expected) / expected, 2)
    gap = hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"))
    wanted = points_near(points, arcs, keys, reach).select("point", "arc", F.struct(off.alias("off"), gap.alias("gap"), "residual", "arc").alias("liking"))
    choices = wanted.groupBy("point").agg(F.count(F.lit(1)).alias("choices"))
    ranked = wanted.join(choices, "point").select(F.col("point").alias("a"), F.col("arc").alias("b"), F.struct("choices", "point").alias("turn"), "liking")
    return graph.widest_matching(ranked).select(F.col("a").alias("point"), F.col("b").alias("arc"))


# Edge directions of the marks tags are drawn in.
NAMED_SHAPES = [([0, 90], "square"), ([45, 135], "diamond"), ([0, 60, 120], "hexagon"), ([30, 90, 150], "hexagon")]


def rings(marks: DataFrame, segs: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Segments around each mark: within 1.6 sizes of it and not the glyph itself. ``reach`` bounds 1.6 x size."""
    s = segs.filter(hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= 0.5)
    box = s.select(*keys, F.col("id").alias("bseg"), F.least("x0", "x1").alias("bx0"), F.least("y0", "y1").alias("by0"), (F.greatest("x0", "x1") + 1e-9).alias("bx1"),
                   (F.greatest("y0", "y1") + 1e-9).alias("by1"), F.struct("x0", "y0", "x1", "y1").alias("bs"))
    around = F.col("size") * 1.6
    m = marks.select(*keys, "id", "cx", "cy", "size", (F.col("cx") - around - 1e-9).alias("x0"), (F.col("cy") - around - 1e-9).alias("y0"), (F.col("cx") + around).alias("x1"), (F.col("cy") + around).alias("y1"))
    p = boxes_overlapping(m, box, keys, reach)
    d0 = hypot(F.col("bs.x0") - F.col("cx"), F.col("bs.y0") - F.col("cy"))
    d1 = hypot(F.col("bs.x1") - F.col("cx"), F.col("bs.y1") - F.col("cy"))
    deg = F.degrees(F.atan2(F.col("bs.y1") - F.col("bs.y0"), F.col("bs.x1") - F.col("bs.x0")))
    return (p.withColumns({"d0": d0, "d1": d1, "angle": (F.bround(F.pmod(deg, F.lit(180.0)) / 15, 0) * 15).cast("bigint")})
            .filter(F.greatest("d0", "d1") > F.col("size") * 0.45))


def enclosures(marks: DataFrame, segs: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Signature, shape and radius of what is drawn around each mark."""
    from mullion.operators import sequence as seq

    k = [*keys, "id"]
    r = rings(marks, segs, keys, reach)
    sig = r.groupBy(*k, "angle").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(*k).agg(F.array_sort(F.collect_list("angle")).alias("signature"))
    radius = r.select(*k, F.explode(F.array("d0", "d1")).alias("d")).groupBy(*k).agg(seq.upper_median("d").alias("radius"))
    j = radius.join(sig, k, "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<bigint>")))
    shape = F.when(F.size("signature") >= 6, "circle")
    for angles, name in NAMED_SHAPES:
        shape = shape.when(F.col("signature") == F.array(*[F.lit(a).cast("bigint") for a in angles]), name)
    return j.withColumn("shape", shape.otherwise(""))


def wall_tags(marks: DataFrame, segs: DataFrame, keys: Sequence[str], reach: float, least: int = 3) -> DataFrame:
    """Marks whose ring shares half of the shape the page draws them in, learned from three or more alike."""
    keys = list(keys)
    e = enclosures(marks, segs, keys, reach).filter(F.size("signature") > 0)
    usual = e.groupBy(*keys, "signature").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).groupBy(*keys).agg(
        F.max_by(F.struct("signature", "n"), F.struct("n", -F.col("first"))).alias("u"))
    usual = usual.select(*keys, F.when(F.col("u.n") >= least, F.col("u.signature")).otherwise(F.array().cast("array<bigint>")).alias("_shape"))
    same = (F.size("_shape") == 0) | (F.size(F.array_intersect("signature", "_shape")) * 2 >= F.size("_shape"))
    return e.join(usual, keys).filter((F.size("signature") >= 2) & same).drop("_shape")
