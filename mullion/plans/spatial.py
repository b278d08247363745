"""Joins by nearness and containment over the box and token lenses."""

from pyspark.sql import functions as F

from mullion.functions import text
from mullion.operators import detections as det, sequence as seq
from mullion.operators.ranking import smallest
from mullion.operators.spatial import as_other, boxes_overlapping, hypot, points_in_reach_of_boxes, points_near
from mullion.plans.scalars import _TAG_SQL
from mullion.registry import query

_D = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))"


@query("J4", """
WITH d AS (SELECT id, page, x0, y0, x1, y1, 'T' || (id + 1) AS read FROM L_box WHERE is_door),
t AS (SELECT page, 'T' || id AS tag, cx, cy FROM L_box WHERE NOT is_door),
g AS (SELECT d.page, d.id, t.tag, read, greatest(d.x0 - t.cx, 0, t.cx - d.x1) AS dx, greatest(d.y0 - t.cy, 0, t.cy - d.y1) AS dy FROM d JOIN t USING (page)),
p AS (SELECT page, id, tag, sqrt(dx * dx + dy * dy) AS gap, sqrt(dx * dx + dy * dy) - CASE WHEN tag = read THEN 2 ELSE 0 END AS cost FROM g WHERE sqrt(dx * dx + dy * dy) <= 85),
r AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY cost, tag) AS a, row_number() OVER (PARTITION BY page, tag ORDER BY cost, id) AS b FROM p)
SELECT page, id, tag, round(gap, 6) AS gap FROM r WHERE a = 1 AND b = 1""")
def j4(t):
    boxes = t.L_box.filter("is_door").selectExpr("page", "id", "concat('T', id + 1) AS read", "x0", "y0", "x1", "y1")
    tags = t.L_box.filter("NOT is_door").selectExpr("page", "concat('T', id) AS tag", "cx AS px", "cy AS py")
    return det.assign(boxes, tags, ["page"]).select("page", "id", "tag", F.round("gap", 6).alias("gap"))


@query("J5", f"""
WITH p AS (SELECT a.page, a.id AS arc, b.id AS point, {_D} AS gap FROM L_box a JOIN L_box b ON a.page = b.page AND a.is_door AND NOT b.is_door WHERE {_D} <= 60),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY page, arc ORDER BY gap, point) = 1),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY page, point ORDER BY gap, arc) = 1),
h AS (SELECT page, count(*) AS n, list_sort(list(gap)) AS g FROM k GROUP BY page)
SELECT page, point, arc, round(gap, 6) AS gap FROM k JOIN h USING (page) WHERE n < 4 OR gap <= greatest(g[CAST(n // 4 + 1 AS INT)] * 3, 10)""")
def j5(t):
    arcs = t.L_box.filter("is_door").selectExpr("page", "id AS arc", "cx", "cy")
    points = t.L_box.filter("NOT is_door").selectExpr("page", "id AS point", "cx AS ox", "cy AS oy")
    return det.nearest_owner(arcs, points, ["page"], 10.0).select("page", "point", "arc", F.round("gap", 6).alias("gap"))


@query("J6", f"""
WITH p AS (SELECT a.page, a.id, b.id AS tid, 'S' || (b.id % 5) AS symbol, {_D} AS gap FROM L_box a JOIN L_box b ON a.page = b.page AND a.is_door AND NOT b.is_door WHERE {_D} <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY gap, symbol, tid) AS rn FROM p),
l AS (SELECT page, id, list(symbol ORDER BY rn) AS s, list(gap ORDER BY rn) AS g FROM r WHERE rn <= 4 GROUP BY page, id),
c AS (SELECT page, id, s[1] AS first, g[1] AS gap, list_filter(range(2, len(s) + 1), lambda i: s[i] <> s[1] AND g[i] <= g[1] * 1.6) AS ix, s FROM l),
q AS (SELECT page, id, first, gap, list_transform(ix, lambda i: s[i]) AS o FROM c)
SELECT page, id, len(o) = 0 AS decided, round(gap, 6) AS gap,
  array_to_string(list_concat([first], list_filter(o, lambda x, i: list_position(o, x) = i))[1:3], ',') AS candidates FROM q""")
def j6(t):
    doors = t.L_box.filter("is_door").select("page", "id", "cx", "cy")
    tags = t.L_box.filter("NOT is_door").selectExpr("page", "id AS tag_id", "concat('S', id % 5) AS symbol", "cx AS ox", "cy AS oy")
    return det.choose_wall(doors, tags, ["page"], 10.0).select(
        "page", "id", "decided", F.round("gap", 6).alias("gap"), F.array_join("candidates", ",").alias("candidates"))


@query("J7", """
SELECT a.page, a.id AS a, b.id AS b FROM L_box a JOIN L_box b ON a.page = b.page AND a.id < b.id
 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def j7(t):
    boxes = t.L_box.select("page", "id", "x0", "y0", "x1", "y1")
    return boxes_overlapping(boxes, as_other(boxes, ["page"]), ["page"], 32.0).filter("id < bid").selectExpr("page", "id AS a", "bid AS b")


@query("J8", """
WITH b AS (SELECT doc, page, min(x0) AS lo, max(x1) + 1 AS hi FROM L_tok GROUP BY ALL)
SELECT doc, page, CAST(floor((x0 - lo) / ((hi - lo) / 4)) AS BIGINT) AS col, count(*) AS n FROM L_tok JOIN b USING (doc, page) GROUP BY ALL""")
def j8(t):
    from mullion.operators.tables import column_of
    b = t.L_tok.groupBy("doc", "page").agg(F.min("x0").alias("lo"), (F.max("x1") + 1).alias("hi"))
    bounds = b.select("doc", "page", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) / 4 * i).alias("bounds"))
    return (t.L_tok.join(bounds, ["doc", "page"]).withColumn("col", column_of(F.col("bounds"), F.col("x0")))
            .groupBy("doc", "page", "col").agg(F.count(F.lit(1)).alias("n")).withColumn("col", F.col("col").cast("bigint")))


_STACK = """
WITH m AS (SELECT doc, page, line, w, x0, y0, x1, y1, size, CASE WHEN w % 3 = 0 AND line % 2 = 0 THEN CAST(100 + (w * 7 + line * 13) % 60 AS VARCHAR) WHEN w % 3 = 0 THEN chr(CAST(65 + (w + line) % 5 AS INT)) ELSE 'TEXT' END AS text
   FROM (SELECT doc, page, line, w, x0, y0, x0 + 18.0 AS x1, y0 + 10.0 AS y1, 9.0 + line % 2 AS size FROM L_tok)),
tags AS (SELECT DISTINCT n.text || l.text AS tag FROM (SELECT DISTINCT text FROM m WHERE regexp_matches(text, '^[0-9]+$') AND CAST(text AS INT) % 2 = 0) n, (SELECT DISTINCT text FROM m WHERE regexp_matches(text, '^[A-C]$')) l),
p AS (SELECT n.doc, n.page, n.line, n.w, l.line AS ll, l.w AS lw, n.text || l.text AS tag FROM m n JOIN m l ON l.doc = n.doc AND l.page = n.page AND l.line = n.line + 1 AND l.w = n.w
      JOIN tags t ON t.tag = n.text || l.text WHERE regexp_matches(n.text, '^[0-9]+$') AND regexp_matches(l.text, '^[A-Z]{1,2}$') AND abs(l.size - n.size) <= n.size * 0.25)
"""


def stack_items(t):
    return t.L_tok.selectExpr(
        "doc", "page", "line", "w", "x0", "y0", "x0 + 18.0D AS x1", "y0 + 10.0D AS y1", "9.0D + line % 2 AS size",
        "CASE WHEN w % 3 = 0 AND line % 2 = 0 THEN CAST(100 + (w * 7 + line * 13) % 60 AS STRING) WHEN w % 3 = 0 THEN chr(65 + (w + line) % 5) ELSE 'TEXT' END AS text")


@query("J9", _STACK + "SELECT doc, page, w, line, tag FROM p")
def j9(t):
    from mullion.operators import plans
    items = stack_items(t)
    numbers = items.filter("text RLIKE '^[0-9]+$' AND CAST(text AS INT) % 2 = 0").select("text").distinct()
    letters = items.filter("text RLIKE '^[A-C]$'").select("text").distinct()
    tags = numbers.withColumn("l", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C")))).join(
        letters.withColumnRenamed("text", "l"), "l", "left_semi").select(F.concat("text", "l").alias("tag"))
    joined = plans.join_stacked(items, tags, ["doc", "page"])
    return joined.filter("merged").selectExpr("doc", "page", "CAST(x0 / 40 AS INT) AS w", "CAST(y0 / 12 AS INT) AS line", "text AS tag")


_DIM = r"regexp_matches(text, '[0-9]')"


@query("J13", f"""
WITH p AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, {_TAG_SQL.format(c='text')} AND CAST(TRY_CAST(text AS INT) AS INT) % 2 = 0 AS is_tag, text LIKE '%-%' AS is_dim FROM L_plan),
hot AS (SELECT doc, page, line, w, cx, cy, coalesce(is_tag, false) AS is_tag, is_dim, unnest([-1, 0, 1]) + CAST(floor(cx / 45) AS BIGINT) AS gx, unnest([-2, -1, 0, 1, 2]) AS gl FROM p WHERE coalesce(is_tag, false) OR is_dim),
h2 AS (SELECT doc, page, line, w, cx, cy, is_tag, is_dim, CAST(floor(cx / 45) AS BIGINT) + dx AS gx, line + dl AS gl FROM p, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-2, -1, 0, 1, 2]) AS dl) WHERE coalesce(is_tag, false) OR is_dim)
SELECT a.doc, a.page, a.line, a.w, CAST(max(CASE WHEN coalesce(b.is_tag, false) THEN 2 ELSE 0 END) + max(CASE WHEN b.is_dim THEN 1 ELSE 0 END) AS BIGINT) AS score
FROM p a JOIN h2 b ON b.doc = a.doc AND b.page = a.page AND b.gx = CAST(floor(a.cx / 45) AS BIGINT) AND b.gl = a.line
 AND abs(a.cx - b.cx) <= 45 AND abs(a.cy - b.cy) <= 28 AND NOT (a.line = b.line AND a.w = b.w) GROUP BY ALL""")
def j13(t):
    from mullion.operators import plans
    items = t.L_plan.select("doc", "page", "line", "w", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
                            F.coalesce(text.is_tag(F.col("text")) & (F.col("text").try_cast("int") % 2 == 0), F.lit(False)).alias("is_tag"),
                            F.col("text").contains("-").alias("is_dim"), F.struct("line", "w").alias("item"))
    return plans.company(items, ["doc", "page"]).selectExpr("doc", "page", "item.line AS line", "item.w AS w", "CAST(score AS BIGINT) AS score").filter("score > 0 OR near")


@query("J14", r"""
WITH p AS (SELECT *, (x0 + x1) / 2 AS cx, regexp_matches(text, '^[A-Z]{1,3}[-.]?[0-9]{1,3}([-.][0-9]{1,3})?[A-Za-z]?$') AS ref FROM L_plan),
o AS (SELECT *, CAST(floor(cx / 22) AS BIGINT) + dx AS gx FROM p, (SELECT unnest([-1, 0, 1]) AS dx))
SELECT a.doc, a.page, a.line, a.w,
  bool_or(b.y0 < a.y0 AND a.y0 - b.y0 <= 26 AND length(b.text) >= 3 AND regexp_matches(b.text, '\p{L}') AND NOT (b.ref AND contains(b.text, '.'))) AS room,
  bool_or(b.y0 > a.y0 AND b.y0 - a.y0 <= 26 AND b.ref) AS bubble
FROM p a JOIN o b ON a.doc = b.doc AND a.page = b.page AND b.gx = CAST(floor(a.cx / 22) AS BIGINT) AND b.line BETWEEN a.line - 3 AND a.line + 3 AND abs(a.cx - b.cx) <= 22
WHERE regexp_matches(a.text, '^[0-9]+$') GROUP BY ALL""")
def j14(t):
    from mullion.operators import plans
    items = t.L_plan.select("doc", "page", "text", "y0", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.struct("line", "w").alias("item"))
    flags = plans.stack_flags(items.filter("text RLIKE '^[0-9]+$'"), items, ["doc", "page"])
    return flags.selectExpr("doc", "page", "item.line AS line", "item.w AS w", "room", "bubble")


@query("P5", """
WITH boxes AS (SELECT DISTINCT doc, page, 0.0 AS bx0, 120.0 AS bx1, line * 12.0 - 1 AS by0, line * 12.0 + 23 AS by1 FROM L_tok WHERE line % 4 = 1)
SELECT doc, page, line, w, text FROM L_tok i WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.doc = i.doc AND b.page = i.page
 AND b.bx0 <= i.x0 AND i.x1 <= b.bx1 AND b.by0 <= i.y0 AND i.y1 <= b.by1)""")
def p5(t):
    from mullion.operators import plans
    boxes = t.L_tok.filter("line % 4 = 1").selectExpr("doc", "page", "0.0D AS bx0", "120.0D AS bx1", "line * 12.0D - 1 AS by0", "line * 12.0D + 23 AS by1").distinct()
    return plans.outside(t.L_tok, boxes, ["doc", "page"]).select("doc", "page", "line", "w", "text")


@query("P6", """
WITH g AS (SELECT doc, page, 12.0 * 2 AS header_bottom, max(y1) - 30 AS bottom, min(x0) AS lo, max(x1) / 2 AS hi FROM L_tok GROUP BY ALL)
SELECT doc, page, line, w, text FROM L_tok JOIN g USING (doc, page) WHERE horizontal AND y0 > header_bottom AND (y0 + y1) / 2 <= bottom AND x0 >= lo AND x0 < hi""")
def p6(t):
    from mullion.operators import tables
    g = t.L_tok.groupBy("doc", "page").agg(F.lit(24.0).alias("header_bottom"), (F.max("y1") - 30).alias("bottom"),
                                           F.array(F.min("x0"), F.max("x1") / 2).alias("bounds"))
    return tables.body_items(t.L_tok, g, ["doc", "page"]).select("doc", "page", "line", "w", "text")


@query("P21", """
WITH s AS (SELECT page, max(abs(x1)) + CASE WHEN page = 0 THEN NULL ELSE 0 END AS w, max(abs(y1)) AS h FROM L_box GROUP BY page)
SELECT id, page, round(x0 / w, 6) AS fx0, round(y0 / h, 6) AS fy0, round(x1 / w, 6) AS fx1, round(y1 / h, 6) AS fy1 FROM L_box JOIN s USING (page)""")
def p21(t):
    from mullion.operators import plans
    sizes = t.L_box.groupBy("page").agg(F.max(F.abs("x1")).alias("width"), F.max(F.abs("y1")).alias("height")).withColumn(
        "width", F.when(F.col("page") != 0, F.col("width")).otherwise(0.0))
    out = plans.to_fraction(t.L_box.select("id", "page", "x0", "y0", "x1", "y1"), sizes, ["page"])
    return out.select("id", "page", *[F.round(c, 6).alias("f" + c) for c in ("x0", "y0", "x1", "y1")])


_REG = "(SELECT page, cx - 60 AS x0, cy - 40 AS y0, cx + 60 AS x1, cy + 40 AS y1 FROM L_box WHERE id % 20 = 0)"


def regions(t):
    return t.L_box.filter("id % 20 = 0").selectExpr("page", "cx - 60 AS x0", "cy - 40 AS y0", "cx + 60 AS x1", "cy + 40 AS y1")


@query("P22", f"""SELECT id, page FROM L_box b WHERE EXISTS (SELECT 1 FROM {_REG} r WHERE r.page = b.page AND b.cx BETWEEN r.x0 AND r.x1 AND b.cy BETWEEN r.y0 AND r.y1)""")
def p22(t):
    return det.in_region(t.L_box, regions(t), ["page"], 64.0).select("id", "page")


@query("P23", """SELECT doc, page, line, w, CASE WHEN horizontal THEN y0 ELSE y1 - (x1 - x0) END AS y0, true AS horizontal FROM L_tok""")
def p23(t):
    from mullion.operators import plans
    return plans.upright(t.L_tok).select("doc", "page", "line", "w", "y0", "horizontal")


@query("P24", """
WITH m AS (SELECT doc, page, median(size) AS s, median(y1 - y0) AS h FROM L_tok GROUP BY ALL)
SELECT doc, page, line, w FROM L_tok JOIN m USING (doc, page) WHERE size >= 0.9 * s AND y1 - y0 <= 2 * h""")
def p24(t):
    from mullion.operators import plans
    return plans.pieces(t.L_tok, ["doc", "page"], small=0.9).select("doc", "page", "line", "w")


@query("J22", f"""
WITH d AS (SELECT *, CASE WHEN id % 4 < 2 THEN tag ELSE '' END AS t FROM L_box WHERE id % 7 <> 0),
x AS (SELECT *, CASE WHEN id % 2 = 0 THEN tag ELSE '' END AS t FROM L_box WHERE id % 7 = 0)
SELECT id, page FROM d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.page = d.page AND (t <> '' AND d.t <> '' AND x.t = d.t
  OR x.t = '' AND d.t = '' AND sqrt((x.cx - d.cx) * (x.cx - d.cx) + (x.cy - d.cy) * (x.cy - d.cy)) <= greatest((x.x1 - x.x0) * 6, (d.x1 - d.x0) * 6, 1e-6) * 0.5))""")
def j22(t):
    wide = "cx - 30 AS x0", "cx + 30 AS x1", "cx", "cy", "page", "id"
    d = t.L_box.filter("id % 7 <> 0").selectExpr(*wide, "IF(id % 4 < 2, tag, '') AS tag")
    dead = t.L_box.filter("id % 7 = 0").selectExpr(*wide, "IF(id % 2 = 0, tag, '') AS tag")
    return det.suppress(d, dead, ["page"], 30.0).select("id", "page")


@query("J23", """
WITH n AS (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE tag END AS t FROM L_box WHERE is_door),
ty AS (SELECT id, page, cx, cy, CASE WHEN id % 5 = 0 THEN tag ELSE '' END AS t, 'K' || (id % 4) AS kind FROM L_box WHERE NOT is_door),
bt AS (SELECT page, t, arg_max(kind, id) AS kind FROM ty WHERE t <> '' GROUP BY page, t),
near AS (SELECT n.id, arg_min(ty.kind, ty.id) AS kind FROM n JOIN ty ON ty.page = n.page AND ty.t = '' AND n.t = '' AND abs(n.cx - ty.cx) <= 25 AND abs(n.cy - ty.cy) <= 25 GROUP BY n.id)
SELECT n.id, n.page, coalesce(bt.kind, near.kind, 'single') AS kind, coalesce(bt.kind, near.kind) IS NOT NULL AS kind_by_hand
FROM n LEFT JOIN bt ON bt.page = n.page AND bt.t = n.t AND n.t <> '' LEFT JOIN near ON near.id = n.id""")
def j23(t):
    new = t.L_box.filter("is_door").selectExpr("id", "page", "cx", "cy", "IF(id % 3 = 0, '', tag) AS tag", "'single' AS kind")
    typed = t.L_box.filter("NOT is_door").selectExpr("id AS typed_id", "page", "cx", "cy", "IF(id % 5 = 0, tag, '') AS tag", "concat('K', id % 4) AS kind")
    return det.keep_types(new, typed, ["page"], "page", 25.0).select("id", "page", "kind", "kind_by_hand")


@query("J29", """
WITH d AS (SELECT id, CASE WHEN id % 6 = 0 THEN '' ELSE tag END AS tag, page AS sheet_id, id % 3 = 0 AS is_primary FROM L_box),
p AS (SELECT tag, arg_max('A' || sheet_id, id) AS counted_on FROM d WHERE is_primary GROUP BY tag)
SELECT d.id, d.tag, coalesce(counted_on, '') AS counted_on FROM d LEFT JOIN p USING (tag)""")
def j29(t):
    d = t.L_box.selectExpr("id", "IF(id % 6 = 0, '', tag) AS tag", "page AS sheet_id", "id % 3 = 0 AS is_primary")
    sheets = t.L_box.selectExpr("page AS sheet_id", "concat('A', page) AS number").distinct()
    return det.counted_on(d, sheets).select("id", "tag", "counted_on")


@query("J31", """
WITH s AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM L_cut)
SELECT b.id AS point, s.id AS seg, round(len, 6) AS len FROM L_box b JOIN s ON s.page = b.page AND len BETWEEN 0.55 * 36 AND 1.35 * 36
 AND abs(mx - b.cx) <= 36 * 1.2 AND abs(my - b.cy) <= 36 * 1.2
QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY (mx - b.cx) * (mx - b.cx) + (my - b.cy) * (my - b.cy), s.id) = 1""")
def j31(t):
    from mullion.operators import plans
    points = t.L_box.selectExpr("page", "id AS point", "cx", "cy")
    return plans.find_leaf(points, t.L_cut, ["page"], 36.0).select("point", "seg", F.round("len", 6).alias("len"))


@query("J32", """
WITH e AS (SELECT id, page, x0 AS ax, y0 AS ay, x1 AS ex, y1 AS ey FROM L_cut UNION ALL SELECT id, page, x1, y1, x0, y0 FROM L_cut),
c AS (SELECT b.id AS point, e.id AS seg, ex, ey, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS len FROM L_box b JOIN e ON e.page = b.page
  AND sqrt((ax - b.cx) * (ax - b.cx) + (ay - b.cy) * (ay - b.cy)) <= 36)
SELECT point, round(ex, 6) AS ex, round(ey, 6) AS ey FROM c WHERE len >= 21.6 QUALIFY row_number() OVER (PARTITION BY point ORDER BY len DESC, seg, ex) = 1""")
def j32(t):
    from mullion.operators import plans
    points = t.L_box.selectExpr("page", "id AS point", "cx", "cy")
    return plans.leader_end(points, t.L_cut, ["page"], 36.0).select("point", F.round("bx", 6).alias("ex"), F.round("by", 6).alias("ey"))


@query("J33", f"""
SELECT a.id, min(b.id) AS partner FROM L_box a JOIN L_box b ON a.page = b.page AND a.id <> b.id
WHERE abs(b.radius - a.radius) <= a.radius * 0.2 AND abs({_D} - 2 * a.radius) <= a.radius * 0.3 GROUP BY a.id""")
def j33(t):
    from mullion.operators import plans
    arcs = t.L_box.select("page", "id", "cx", "cy", "radius")
    return plans.partners(arcs, ["page"]).select("id", "partner")


@query("J34", f"""
SELECT b.id AS point, a.id AS arc FROM L_box a JOIN L_box b ON a.page = b.page AND a.is_door AND NOT b.is_door AND abs(a.cx - b.cx) <= 70 AND abs(a.cy - b.cy) <= 70
QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY abs(a.radius - 25) / 25, a.residual, {_D}, a.id) = 1""")
def j34(t):
    from mullion.operators import plans
    arcs = t.L_box.filter("is_door").selectExpr("page", "id AS arc", "cx AS ox", "cy AS oy", "radius", "residual")
    points = t.L_box.filter("NOT is_door").selectExpr("page", "id AS point", "cx", "cy")
    return plans.best_arc(points, arcs, ["page"], 70.0, 25.0).select("point", "arc")


# Chains of arcs: 0.3 to 3 rad long, radius 50 to 80, points off the circle by nothing, a little or a lot.
_ARC = """page * 100 + id % 12 AS chain, page, 50.0{d} + 10 * ((page + id % 12) % 4) AS r, (id * 0.07{d}) % (0.3{d} + 0.3{d} * ((page + id % 12) % 10)) AS a, ((id % 12) % 3) * ((id % 12) % 3) * 0.0005{d} AS e, id, cx, cy"""
_ARCS = """p AS (SELECT chain, page, id, r * cos(a) + cx * e AS x, r * sin(a) + cy * e AS y FROM (SELECT """ + _ARC.format(d="::DOUBLE") + """ FROM L_box)),
m AS (SELECT chain, avg(x) AS mx, avg(y) AS my FROM p GROUP BY chain), c AS (SELECT p.*, mx, my, x - mx AS u, y - my AS v FROM p JOIN m USING (chain)),
s AS (SELECT chain, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu, count(*) AS n FROM c GROUP BY chain),
f AS (SELECT chain, n, ((uuu+uvv)*vv - (vvv+vuu)*uv) / (2*(uu*vv-uv*uv)) + mx AS fx, ((vvv+vuu)*uu - (uuu+uvv)*uv) / (2*(uu*vv-uv*uv)) + my AS fy FROM s WHERE abs(2*(uu*vv-uv*uv)) >= 1e-9),
k AS (SELECT chain, n, fx, fy, avg(r) AS radius, stddev_pop(r) AS residual, max(g) - min(g) AS span FROM (SELECT *, sqrt((x-fx)*(x-fx)+(y-fy)*(y-fy)) AS r, degrees(atan2(y-fy, x-fx)) AS g FROM p JOIN f USING (chain)) GROUP BY chain, n, fx, fy),
fit AS (SELECT *, n >= 4 AND residual <= 0.08 AND span BETWEEN 45 AND 135 AND abs(radius - 50) <= 22.5 AS accepted FROM k)"""


def arc_chains(t):
    return t.L_box.selectExpr(*_ARC.format(d="D").split(", ")).selectExpr("chain", "page", "id", "r * cos(a) + cx * e AS x", "r * sin(a) + cy * e AS y")


@query("A25", f"""WITH {_ARCS} SELECT chain, n, round(fx, 4) AS cx, round(fy, 4) AS cy, round(radius, 4) AS radius, accepted FROM fit""")
def a25(t):
    fits = det.fit_circles(arc_chains(t).select("chain", "x", "y"), ["chain"])
    return fits.select("chain", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "radius")], det.is_arc(F.lit(50.0)).alias("accepted"))


@query("A26", """
WITH pt AS (SELECT page, id AS point, cx, cy FROM L_box WHERE NOT is_door),
c AS (SELECT a.page, round_even(a.radius * 2, 0) / 2 AS r, count(DISTINCT point) AS doors FROM L_box a JOIN pt ON pt.page = a.page AND a.is_door AND abs(a.cx - pt.cx) <= 80 AND abs(a.cy - pt.cy) <= 80 GROUP BY ALL),
b AS (SELECT page, max(doors) AS best FROM c WHERE r >= 3 GROUP BY page HAVING max(doors) >= 3)
SELECT page, max(r) AS radius, max(best) AS doors FROM c JOIN b USING (page) WHERE r >= 3 AND doors >= best * 0.8 GROUP BY page""")
def a26(t):
    arcs = t.L_box.filter("is_door").select("page", "cx", "cy", "radius")
    points = t.L_box.filter("NOT is_door").selectExpr("page", "id AS point", "cx AS ox", "cy AS oy")
    return det.calibrate(arcs, points, ["page"], 80.0)


@query("A27", """
WITH m AS (SELECT page, min(cx) AS x0, min(cy) AS y0, max(cx) AS x1, max(cy) AS y1 FROM L_box WHERE is_door GROUP BY page),
w AS (SELECT c.page, min(greatest(least(c.x0, c.x1), m.x0 - 30)) AS wx0, min(greatest(least(c.y0, c.y1), m.y0 - 30)) AS wy0,
             max(least(greatest(c.x0, c.x1), m.x1 + 30)) AS wx1, max(least(greatest(c.y0, c.y1), m.y1 + 30)) AS wy1
      FROM L_cut c JOIN m USING (page) WHERE sqrt((c.x1 - c.x0) * (c.x1 - c.x0) + (c.y1 - c.y0) * (c.y1 - c.y0)) >= 40
       AND greatest(c.x0, c.x1) >= m.x0 - 30 AND least(c.x0, c.x1) <= m.x1 + 30 AND greatest(c.y0, c.y1) >= m.y0 - 30 AND least(c.y0, c.y1) <= m.y1 + 30 GROUP BY c.page)
SELECT page, round(least(x0, wx0), 6) AS x0, round(least(y0, wy0), 6) AS y0, round(greatest(x1, wx1), 6) AS x1, round(greatest(y1, wy1), 6) AS y1 FROM m LEFT JOIN w USING (page)""")
def a27(t):
    from mullion.operators import plans
    out = plans.plan_extent(t.L_box.filter("is_door").select("page", "cx", "cy"), t.L_cut, ["page"], pad=30.0, long=40.0)
    return out.select("page", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("A17", """
WITH n AS (SELECT user_id AS doc, event_type AS shape, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT doc, shape, n FROM n QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1 AND n >= 5""")
def a17(t):
    return det.usual_shape(t.events.selectExpr("user_id AS doc", "event_id AS id", "event_type AS shape"), ["doc"])


@query("X15", f"""
WITH {_ARCS}, d AS (SELECT event_id AS id, user_id AS doc, event_type AS shape, CASE WHEN event_id % 9 > 0 THEN 'T' || (event_id % 9) ELSE '' END AS tag, value > 10 AS beside FROM events),
b AS (SELECT DISTINCT doc, tag FROM d WHERE beside AND tag <> ''), q AS (SELECT d.* FROM d WHERE beside OR (doc, tag) NOT IN (SELECT doc, tag FROM b)),
cnt AS (SELECT doc, shape, count(*) AS n, min(id) AS first FROM q GROUP BY ALL),
u AS (SELECT doc, shape AS usual FROM cnt QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1 AND n >= 5),
w AS (SELECT DISTINCT q.doc, tag FROM q JOIN u ON u.doc = q.doc AND q.shape = u.usual WHERE tag <> '')
SELECT q.id, q.doc, q.tag, q.tag <> '' OR q.id % 1200 IN (SELECT chain FROM fit WHERE accepted) AS shown
FROM q LEFT JOIN u ON u.doc = q.doc WHERE u.usual IS NULL OR q.shape = u.usual OR (q.doc, q.tag) NOT IN (SELECT doc, tag FROM w)""")
def x15(t):
    d = t.events.selectExpr("event_id AS id", "user_id AS doc", "event_type AS shape", "IF(event_id % 9 > 0, concat('T', event_id % 9), '') AS tag", "value > 10 AS beside")
    arcs = det.accept_arcs(det.fit_circles(arc_chains(t).select("chain", "x", "y"), ["chain"]), F.lit(50.0)).select("chain")
    beside_arc = d.select("doc", "id", (F.col("id") % 1200).alias("chain")).join(arcs, "chain", "left_semi")
    return det.confirm(d, beside_arc, ["doc"]).select("id", "doc", "tag", "shown")


@query("X20", """
SELECT id, CASE WHEN CASE WHEN id % 4 = 0 THEN (id % 3 + 1) >= 2 ELSE (id % 7 + 1) * 9.0 >= radius * 1.5 END THEN 'double_swing' ELSE 'single_swing' END AS kind FROM L_box""")
def x20(t):
    return t.L_box.select("id", det.swing_kind(F.col("id") % 3 + 1, F.when(F.col("id") % 4 != 0, F.col("id") % 7 + 1.0), F.lit(9.0), F.col("radius")).alias("kind"))


@query("X19", """
WITH m AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM L_box GROUP BY page),
n AS (SELECT *, CAST(greatest(ceil((x1 - x0 - 30) / 120.0), 1) AS BIGINT) AS nx, CAST(greatest(ceil((y1 - y0 - 30) / 120.0), 1) AS BIGINT) AS ny FROM m),
t AS (SELECT *, unnest(range(nx)) AS i FROM n), u AS (SELECT *, unnest(range(ny)) AS j FROM t)
SELECT page, i, j, round(x0 + i * 120, 6) AS tx0, round(y0 + j * 120, 6) AS ty0, round(least(x0 + i * 120 + 150, x1), 6) AS tx1, round(least(y0 + j * 120 + 150, y1), 6) AS ty1 FROM u""")
def x19(t):
    from mullion.operators import plans
    m = t.L_box.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return plans.plan_tiles(m, 150.0, 30.0).select("page", "i", "j", *[F.round(c, 6).alias(c) for c in ("tx0", "ty0", "tx1", "ty1")])


@query("X32", """
WITH r AS (SELECT id, page, CASE WHEN id % 4 = 0 THEN 0.001 ELSE 1.0 END * (id % 1100) AS a, CASE WHEN id % 4 = 0 THEN 0.001 ELSE 1.0 END * (id * 7 % 1000) AS b FROM L_box),
n AS (SELECT id, page, CASE WHEN greatest(a, b) <= 1 THEN a ELSE a / 1000 END AS fx, CASE WHEN greatest(a, b) <= 1 THEN b ELSE b / 1000 END AS fy FROM r)
SELECT id, page, round((100 + fx * 300 - 20) / 1000, 6) AS x0, round((50 + fy * 200 - 20) / 800, 6) AS y0, round((100 + fx * 300 + 20) / 1000, 6) AS x1, round((50 + fy * 200 + 20) / 800, 6) AS y1
FROM n WHERE fx BETWEEN 0 AND 1 AND fy BETWEEN 0 AND 1""")
def x32(t):
    from mullion.operators import plans
    scale = F.when(F.col("id") % 4 == 0, 0.001).otherwise(1.0)
    reply = t.L_box.select("id", "page", (scale * (F.col("id") % 1100)).alias("a"), (scale * (F.col("id") * 7 % 1000)).alias("b"), F.lit(40.0).alias("span"))
    tiles = t.L_box.select("page").distinct().selectExpr("page", "100.0D AS tx0", "50.0D AS ty0", "400.0D AS tx1", "250.0D AS ty1", "1000.0D AS width", "800.0D AS height")
    return plans.tile_points(reply, tiles, ["page"]).select("id", "page", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])
