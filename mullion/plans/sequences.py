"""Ordered folds over the driver tables."""

from pyspark.sql import functions as F

from mullion.functions import text
from mullion.lenses import HEADINGS, pick
from mullion.operators import graph, sequence as seq
from mullion.operators.spatial import as_other, hypot, points_near
from mullion.plans.scalars import header_rows, _HEADS, _TAG_SQL
from mullion.registry import query


@query("A18", """
SELECT k, list_sort(list(v))[CAST(len(list(v)) // 2 + 1 AS INT)] AS upper_median, median(v) AS true_median
FROM (SELECT l_partkey AS k, l_quantity AS v FROM lineitem) GROUP BY k""")
def a18(t):
    return (t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v")).groupBy("k")
            .agg(seq.upper_median("v").alias("upper_median"), F.median("v").alias("true_median")))


_DAYS = "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE)"


def ship_days(t):
    return t.lineitem.selectExpr("l_orderkey AS k", "CAST(datediff(CAST(l_shipdate AS DATE), DATE'1992-01-01') AS DOUBLE) AS v")


@query("W8", f"""
WITH RECURSIVE d AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS i FROM (SELECT DISTINCT l_orderkey AS k, {_DAYS} AS v FROM lineitem)),
f AS (SELECT k, v, i, v AS first FROM d WHERE i = 1
      UNION ALL SELECT d.k, d.v, d.i, CASE WHEN d.v - f.first > 20 THEN d.v ELSE f.first END FROM f JOIN d ON d.k = f.k AND d.i = f.i + 1)
SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, f.v, f.first AS cluster
FROM lineitem JOIN f ON f.k = l_orderkey AND f.v = {_DAYS}""")
def w8(t):
    d = t.lineitem.selectExpr("l_orderkey AS k", "l_linenumber AS line", "l_partkey AS part",
                              "CAST(datediff(CAST(l_shipdate AS DATE), DATE'1992-01-01') AS DOUBLE) AS v")
    return seq.anchored(d, ["k"], "v", 20.0, 365.0)


@query("W9", """
WITH o AS (SELECT *, max(e) OVER (PARTITION BY doc, page ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM L_seg)
SELECT doc, page, id, CAST(sum(CASE WHEN pe IS NULL OR s > pe + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY s, e, id) AS BIGINT) AS run FROM o""")
def w9(t):
    return seq.chained(t.L_seg, ["doc", "page"], "s", "e", 5.0, 365.0, ties=["id"]).select("doc", "page", "id", F.col("run").cast("bigint").alias("run"))


_EP = "CAST(round(l_extendedprice / 1000) AS DOUBLE)"


@query("W10", f"""
WITH RECURSIVE d AS (SELECT k, v, n, row_number() OVER (PARTITION BY k ORDER BY v) AS i FROM (SELECT l_orderkey AS k, {_EP} AS v, count(*) AS n FROM lineitem GROUP BY ALL)),
f AS (SELECT k, v, i, v AS first, v * n AS total, n FROM d WHERE i = 1
  UNION ALL SELECT d.k, d.v, d.i, CASE WHEN abs(f.total / f.n - d.v) <= 2.5 THEN f.first ELSE d.v END,
         CASE WHEN abs(f.total / f.n - d.v) <= 2.5 THEN f.total ELSE 0 END + d.v * d.n,
         CASE WHEN abs(f.total / f.n - d.v) <= 2.5 THEN f.n ELSE 0 END + d.n
  FROM f JOIN d ON d.k = f.k AND d.i = f.i + 1)
SELECT k, first AS line_start, CAST(count(*) AS BIGINT) AS levels, CAST(sum(n_rows) AS BIGINT) AS rows
FROM (SELECT f.k, f.first, d.n AS n_rows FROM f JOIN d ON d.k = f.k AND d.i = f.i) GROUP BY k, first""")
def w10(t):
    d = t.lineitem.selectExpr("l_orderkey AS k", "CAST(round(l_extendedprice / 1000) AS DOUBLE) AS v")
    return seq.mean_lines(d, ["k"], "v", 2.5, 64.0).groupBy("k", "line_start").agg(
        F.countDistinct("v").alias("levels"), F.count(F.lit(1)).alias("rows"))


_SPLIT_SQL = """
WITH g AS (SELECT *, lag(e) OVER (PARTITION BY doc, page, axis ORDER BY s, e, id) AS pe FROM L_seg),
b AS (SELECT doc, page, axis, list_sort(list(s - pe) FILTER (WHERE s > pe)) AS gaps FROM g GROUP BY ALL),
m AS (SELECT doc, page, axis, least(400, greatest(4 * coalesce(gaps[CAST(len(gaps) // 2 + 1 AS INT)], 0), 120)) AS budget FROM b)
SELECT g.doc, g.page, g.axis, g.id, CAST(sum(CASE WHEN s - pe > budget THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc, g.page, g.axis ORDER BY s, e, id) AS BIGINT) AS part
FROM g JOIN m USING (doc, page, axis)"""


@query("W11", _SPLIT_SQL)
def w11(t):
    from mullion.operators import pages
    return pages.split_rows(t.L_seg.withColumnsRenamed({"s": "x0", "e": "x1"}), ["doc", "page", "axis"], 365.0, ["id"]).select(
        "doc", "page", "axis", "id", F.col("part").cast("bigint").alias("part"))


@query("W12", f"""
WITH h AS (SELECT id, unnest([{_HEADS}]) AS heading, unnest(range(10)) AS i FROM L_title),
s AS (SELECT *, CASE WHEN regexp_replace(heading, '[.:]+$', '') IN ('NO','NUMBER','DOOR NO','DOOR NUMBER','MARK','DOOR MARK','DR NO') THEN 1 ELSE 0 END AS st FROM h)
SELECT id, i, heading, CAST(greatest(sum(st) OVER (PARTITION BY id ORDER BY i) - 1, 0) AS BIGINT) AS part FROM s""")
def w12(t):
    from mullion.operators import pages
    cells = header_rows(t).select("id", F.posexplode("headers").alias("i", "heading"))
    return pages.split_at_starts(cells, ["id"], F.lit(0), ["i"], "heading").select(
        "id", F.col("i").cast("bigint").alias("i"), "heading", F.col("part").cast("bigint").alias("part"))


@query("W13", f"""
WITH tags AS (SELECT doc, page, x0, x0 + 3.0 * length(text) AS cx FROM L_plan WHERE {_TAG_SQL.format(c='text')}),
r AS (SELECT doc, page, 1 AS pref, x0 AS v, x0 FROM tags UNION ALL SELECT doc, page, 0, cx, x0 FROM tags),
c AS (SELECT doc, page, pref, v, count(*) OVER w AS run, min(x0) OVER w AS tag_x FROM r
      WINDOW w AS (PARTITION BY doc, page, pref ORDER BY v RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT doc, page, CAST(run AS BIGINT) AS run, tag_x FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY run DESC, pref DESC, v) AS rn FROM c) WHERE rn = 1""")
def w13(t):
    from mullion.operators import pages
    tags = t.L_plan.filter(text.is_tag(F.col("text"))).select("doc", "page", "x0", (F.col("x0") + 3.0 * F.length("text")).alias("cx"))
    return pages.tag_run(tags, ["doc", "page"])


@query("W14", f"""
WITH d AS (SELECT DISTINCT doc, page, s AS v FROM L_seg),
g AS (SELECT *, v - lag(v) OVER (PARTITION BY doc, page ORDER BY v) AS gap FROM d),
p AS (SELECT doc, page, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gs FROM g GROUP BY ALL),
r AS (SELECT g.doc, g.page, v, sum(CASE WHEN gap > gs[CAST(len(gs) // 2 + 1 AS INT)] * 3 THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc, g.page ORDER BY v) AS run
      FROM g JOIN p USING (doc, page)),
a AS (SELECT doc, page, run, count(*) AS rows, min(v) AS top, max(v) AS bottom FROM r GROUP BY ALL)
SELECT doc, page, rows, top, bottom FROM a QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY rows DESC, run) = 1""")
def w14(t):
    return seq.longest_run(t.L_seg.select("doc", "page", F.col("s").alias("v")), ["doc", "page"], "v", 3.0, 365.0).select(
        "doc", "page", "rows", "top", "bottom")


@query("W15", """
WITH d AS (SELECT l_orderkey AS k, l_partkey AS x, l_suppkey AS y, CAST(l_linenumber AS BIGINT) AS v FROM lineitem),
g AS (SELECT *, CASE WHEN abs(v - lag(v) OVER (PARTITION BY k ORDER BY x, y, v)) = 1 THEN 0 ELSE 1 END AS brk FROM d),
r AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY x, y, v) AS run FROM g),
b AS (SELECT k, max(n) AS best FROM (SELECT k, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY k HAVING max(n) >= 3)
SELECT k, x, y, v, EXISTS (SELECT 1 FROM d o WHERE o.k = d.k AND abs(o.v - d.v) <= 1 AND (o.x, o.y, o.v) <> (d.x, d.y, d.v)) AS numbered
FROM d JOIN b USING (k)""")
def w15(t):
    from mullion.operators import pages
    d = t.lineitem.selectExpr("l_orderkey AS k", "l_partkey AS x", "l_suppkey AS y", "CAST(l_linenumber AS BIGINT) AS v")
    return pages.numbered_runs(d, ["k"], "v", ["x", "y", "v"], F.floor(F.col("x") / 512), least=3, reach=1)


@query("W16", """
WITH d AS (SELECT user_id AS k, event_id AS y, event_type AS cell, event_id % 3 <> 0 AS has_tag FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y) = 1 OR has_tag AS starts FROM d),
p AS (SELECT *, max(CASE WHEN starts THEN y END) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS py FROM s),
g AS (SELECT *, list_sort(list(CASE WHEN starts THEN y - py END) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ASC', 'NULLS LAST') AS gs,
  count(CASE WHEN starts THEN y - py END) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM p),
e AS (SELECT k, min(y) AS e FROM g WHERE n > 0 AND y - py > 4 * gs[n // 2 + 1] GROUP BY k),
r AS (SELECT s.*, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY s.k ORDER BY y) AS row_no FROM s LEFT JOIN e ON e.k = s.k WHERE e.e IS NULL OR y < e.e)
SELECT k, CAST(row_no AS BIGINT) AS row_no, string_agg(cell, ' ' ORDER BY y) AS text, min(y) AS y FROM r GROUP BY k, row_no""")
def w16(t):
    from mullion.operators import rows
    d = t.events.selectExpr("user_id AS k", "CAST(event_id AS DOUBLE) AS y", "array(event_type) AS cells", "event_id % 3 <> 0 AS has_tag")
    return rows.stitch(d, ["k"], 256.0).select(
        "k", F.col("row_no").cast("bigint").alias("row_no"), F.get("cells", F.lit(0)).alias("text"), F.col("y").cast("bigint").alias("y"))


@query("W17", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN CAST(value AS VARCHAR) END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM events""")
def w17(t):
    label = F.when(F.col("event_type") == "error", F.col("value").cast("string"))
    return seq.running(t.events.select("event_id", "user_id", "event_type", "value"), ["user_id"], F.floor(F.col("event_id") / 1024), ["event_id"],
                       {"level": ("last", label)}).select("event_id", "user_id", "level")


@query("W18", """
WITH c AS (SELECT doc, page, greatest(s, 500) AS a, least(e, 1500) AS b FROM L_seg WHERE e > 500 AND s < 1500),
o AS (SELECT *, max(b) OVER (PARTITION BY doc, page ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c)
SELECT doc, page, sum(greatest(b - greatest(a, coalesce(seen, a)), 0)) AS covered FROM o GROUP BY doc, page""")
def w18(t):
    return seq.coverage(t.L_seg, ["doc", "page"], "s", "e", F.lit(500.0), F.lit(1500.0), 256.0)


@query("W19", """
WITH days AS (SELECT doc, page, unnest(generate_series(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS x FROM L_seg),
n AS (SELECT doc, page, x, count(*) AS n FROM days GROUP BY ALL),
st AS (SELECT doc, page, greatest(1, count(DISTINCT pos) // 25) AS stray FROM L_seg GROUP BY ALL),
a AS (SELECT doc, page, x, x - row_number() OVER (PARTITION BY doc, page ORDER BY x) AS grp FROM n JOIN st USING (doc, page) WHERE n > stray)
SELECT doc, page, min(x) AS lo, max(x) + 1 AS hi FROM a GROUP BY doc, page, grp""")
def w19(t):
    stray = t.L_seg.groupBy("doc", "page").agg(F.greatest(F.lit(1), F.floor(F.countDistinct("pos") / 25)).alias("stray"))
    return seq.histogram_spans(t.L_seg, ["doc", "page"], "s", "e", stray, 256.0)


@query("W20", """
WITH d AS (SELECT DISTINCT doc, page, s AS v FROM L_seg),
g AS (SELECT *, v - lag(v) OVER (PARTITION BY doc, page ORDER BY v) AS gap FROM d),
p AS (SELECT doc, page, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gs FROM g GROUP BY ALL),
r AS (SELECT g.doc, g.page, v, sum(CASE WHEN gap > gs[CAST(len(gs) // 2 + 1 AS INT)] * 3 THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc, g.page ORDER BY v) AS run
      FROM g JOIN p USING (doc, page))
SELECT doc, page, v FROM r WHERE run = 0""")
def w20(t):
    return seq.pitch_runs(t.L_seg.select("doc", "page", F.col("s").alias("v")), ["doc", "page"], "v", 3.0, 365.0).filter(
        "run = 0").select("doc", "page", "v")


@query("W22", """
WITH RECURSIVE d AS (SELECT pdf_page, id, finish, size, row_number() OVER (PARTITION BY pdf_page ORDER BY id) AS i,
   CASE WHEN id % 9 = 0 OR manufacturer IS DISTINCT FROM lag(manufacturer) OVER (PARTITION BY pdf_page ORDER BY id) AND id % 2 = 0 THEN 1 ELSE 0 END AS brk FROM L_price),
f AS (SELECT pdf_page, id, i, [finish] AS seen, CAST(1 AS BIGINT) AS block FROM d WHERE i = 1
  UNION ALL SELECT d.pdf_page, d.id, d.i, CASE WHEN d.brk = 1 OR list_contains(f.seen, d.finish) THEN [d.finish] ELSE list_append(f.seen, d.finish) END,
       f.block + CASE WHEN d.brk = 1 OR list_contains(f.seen, d.finish) THEN 1 ELSE 0 END FROM f JOIN d ON d.pdf_page = f.pdf_page AND d.i = f.i + 1)
SELECT pdf_page, id, block FROM f""")
def w22(t):
    from mullion.operators import bookread
    p = t.L_price.select("pdf_page", "id", "finish", "manufacturer")
    prev = seq.running(p, ["pdf_page"], F.floor(F.col("id") / 4096), ["id"], {"pm": ("last", F.col("manufacturer"))}, inclusive=False)
    forced = prev.withColumn("forced", (F.col("id") % 9 == 0) | (~F.col("manufacturer").eqNullSafe(F.col("pm")) & (F.col("id") % 2 == 0)))
    return bookread.finish_blocks(forced, ["pdf_page"], "id", 4096.0).select("pdf_page", "id", F.col("block").cast("bigint").alias("block"))


@query("W23", """
WITH RECURSIVE tb AS (SELECT document_id, level, door_type, count(DISTINCT door_tag) AS n, count(*) AS rows,
       row_number() OVER (PARTITION BY document_id ORDER BY count(DISTINCT door_material) DESC, count(*) DESC, level, door_type) AS rk FROM L_doors GROUP BY document_id, level, door_type),
tg AS (SELECT DISTINCT document_id, level, door_type, door_tag FROM L_doors),
c AS (SELECT a.document_id, ra.rk AS a, rb.rk AS b FROM tg a JOIN tg b ON a.document_id = b.document_id AND a.door_tag = b.door_tag
      JOIN tb ra ON ra.document_id = a.document_id AND ra.level = a.level AND ra.door_type = a.door_type
      JOIN tb rb ON rb.document_id = b.document_id AND rb.level = b.level AND rb.door_type = b.door_type
      WHERE rb.rk < ra.rk GROUP BY a.document_id, ra.rk, rb.rk, ra.n HAVING count(*) * 2 > ra.n),
f AS (SELECT document_id, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS kept FROM tb WHERE rk = 1
  UNION ALL SELECT f.document_id, f.i + 1, CASE WHEN len(list_filter(f.kept, lambda k: list_contains(coalesce(cc.bs, []), k))) > 0 THEN f.kept ELSE list_append(f.kept, f.i + 1) END
  FROM f JOIN tb ON tb.document_id = f.document_id AND tb.rk = f.i + 1
  LEFT JOIN (SELECT document_id, a, list(b) AS bs FROM c GROUP BY document_id, a) cc ON cc.document_id = f.document_id AND cc.a = f.i + 1)
SELECT tb.document_id, tb.level, tb.door_type, tb.rows FROM tb JOIN (SELECT document_id, arg_max(kept, i) AS kept FROM f GROUP BY document_id) k USING (document_id)
WHERE list_contains(k.kept, tb.rk)""")
def w23(t):
    from mullion.operators import tables
    rows = t.L_doors.select("document_id", "level", "door_type", "door_tag", "door_material")
    tabs = rows.groupBy("document_id", "level", "door_type").agg(
        F.countDistinct("door_material").alias("fields"), F.count(F.lit(1)).alias("rows"))
    return tables.one_reading(tabs, rows, ["document_id"], ["level", "door_type"], [-F.col("fields"), -F.col("rows")]).select(
        "document_id", "level", "door_type", "rows")


@query("W24", """
WITH g AS (SELECT *, lag(x1) OVER w AS px, lag(y0) OVER w AS py FROM L_plan WINDOW w AS (PARTITION BY doc, page ORDER BY y0, x0)),
r AS (SELECT *, sum(CASE WHEN py IS NULL OR abs(y0 - py) > 6 OR x0 - px > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y0, x0) AS run FROM g)
SELECT doc, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0) AS text, max(size) AS size FROM r GROUP BY doc, page, run""")
def w24(t):
    from mullion.operators import pages
    return pages.stitch_lines(t.L_plan.withColumn("horizontal", F.lit(True)), ["doc", "page"]).select("doc", "page", "x0", "y0", "x1", "text", "size")


@query("W25", """
WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM L_box a JOIN L_box b ON a.page = b.page AND a.id <> b.id
    AND b.y0 - a.y1 >= 0 AND b.y0 - a.y1 <= 12 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / 10.0 >= 0.35),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id AS id, id AS root FROM L_box UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id)
SELECT id, min(root) AS block FROM r GROUP BY id""")
def w25(t):
    from mullion.operators import pages
    return pages.caption_blocks(t.L_box.select("id", "page", "x0", "y0", "x1", "y1"), ["page"]).select("id", "block")


_NEARER = "(r.confidence = 'high' AND c.confidence <> 'high' OR r.confidence = 'medium' AND c.confidence = 'low' OR r.confidence = c.confidence AND r.id < c.id)"


@query("W5", f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id) AS i FROM L_box),
f AS (SELECT page, CAST(1 AS BIGINT) AS i, [{{'x': cx, 'y': cy, 'id': id}}] AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.page, o.i, CASE WHEN len(list_filter(f.kept, lambda k: sqrt((k.x - o.cx) * (k.x - o.cx) + (k.y - o.cy) * (k.y - o.cy)) <= 30)) > 0 THEN f.kept
     ELSE list_append(f.kept, {{'x': o.cx, 'y': o.cy, 'id': o.id}}) END FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT page, unnest(list_transform(kept, lambda k: k.id)) AS id FROM (SELECT page, arg_max(kept, i) AS kept FROM f GROUP BY page)""")
def w5(t):
    from mullion.operators import detections
    return detections.drop_near(t.L_box.select("id", "page", "cx", "cy", "confidence"), ["page"], 30.0).select("page", "id")


@query("W4", """
WITH RECURSIVE tagged AS (SELECT page, id, tag, x0, y0, x1, y1 FROM L_box WHERE is_door
    QUALIFY row_number() OVER (PARTITION BY page, tag ORDER BY residual < 0.08 DESC, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id) = 1),
big AS (SELECT id, page, cx - 15 AS x0, cx + 15 AS x1, cy - 15 AS y0, cy + 15 AS y1 FROM L_box WHERE NOT is_door),
open AS (SELECT * FROM big b WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.page = b.page AND t.x0 < b.x1 AND b.x0 < t.x1 AND t.y0 < b.y1 AND b.y0 < t.y1)),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS i FROM open),
f AS (SELECT page, CAST(1 AS BIGINT) AS i, [{'a': x0, 'b': y0, 'id': id}] AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.page, o.i, CASE WHEN len(list_filter(f.kept, lambda k: abs(k.a - o.x0) < 30 AND abs(k.b - o.y0) < 30)) > 0 THEN f.kept
     ELSE list_append(f.kept, {'a': o.x0, 'b': o.y0, 'id': o.id}) END FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT page, id, true AS tagged FROM tagged UNION ALL
SELECT page, unnest(list_transform(kept, lambda k: k.id)), false FROM (SELECT page, arg_max(kept, i) AS kept FROM f GROUP BY page)""")
def w4(t):
    from mullion.operators import detections
    det = t.L_box.selectExpr("id", "page", "IF(is_door, tag, '') AS tag", "residual < 0.08 AS has_arc", "confidence",
                             "cx - IF(is_door, 5, 15) AS x0", "cy - IF(is_door, 5, 15) AS y0", "cx + IF(is_door, 5, 15) AS x1", "cy + IF(is_door, 5, 15) AS y1")
    return detections.one_per_door(det, ["page"]).select("page", "id", (F.col("tag") != "").alias("tagged"))
