"""Merge and replace writes, each as old + new -> next."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mullion.operators import merges as mg, prices as pr, tables as tb
from mullion.plans.pricing import _CODES, brands
from mullion.registry import query

_DC = "document_id, door_tag, level, door_width, source"
_OLD = "old AS (SELECT document_id, door_tag, level, door_width, source, row_index FROM L_doors WHERE suppkey % 10 < 7)"
_NEW = "new AS (SELECT document_id, door_tag, level, door_width, 'schedule' AS source, row_index FROM L_doors WHERE suppkey % 10 >= 4 AND document_id % 3 = 0)"


def old_new(t):
    cols = ["document_id", "door_tag", "level", "door_width", "source", "row_index"]
    old = t.L_doors.filter("suppkey % 10 < 7").select(*cols)
    new = t.L_doors.filter("suppkey % 10 >= 4 AND document_id % 3 = 0").withColumn("source", F.lit("schedule")).select(*cols)
    return old, new


@query("M1", f"""
WITH {_OLD}, {_NEW}, k AS (SELECT o.*, (SELECT count(*) FROM new n WHERE n.document_id = o.document_id) + row_number() OVER (PARTITION BY document_id ORDER BY row_index, door_tag) - 1 AS ri FROM old o
  WHERE source = 'plan' AND document_id IN (SELECT document_id FROM new) AND (document_id, door_tag) NOT IN (SELECT document_id, door_tag FROM new))
SELECT {_DC}, row_index FROM old WHERE document_id NOT IN (SELECT document_id FROM new)
UNION ALL SELECT {_DC}, row_index FROM new UNION ALL SELECT {_DC}, ri FROM k""")
def m1(t):
    return mg.replace_document(*old_new(t))


@query("M2", """
WITH o AS (SELECT match_key, manufacturer, min(id) AS id FROM L_price WHERE id % 3 < 2 GROUP BY ALL), n AS (SELECT match_key, manufacturer, max(id) + 100000 AS id FROM L_price WHERE id % 3 > 0 GROUP BY ALL)
SELECT coalesce(o.manufacturer, n.manufacturer) AS manufacturer, coalesce(o.match_key, n.match_key) AS match_key, CASE WHEN o.id % 4 = 0 THEN o.id ELSE coalesce(n.id, o.id) END AS id
FROM o FULL JOIN n ON o.manufacturer = n.manufacturer AND o.match_key = n.match_key""")
def m2(t):
    keys = ["manufacturer", "match_key"]
    old = t.L_price.filter("id % 3 < 2").groupBy(*keys).agg(F.min("id").alias("id"))
    new = t.L_price.filter("id % 3 > 0").groupBy(*keys).agg((F.max("id") + 100000).alias("id"))
    return mg.upsert(old, new, keys, F.col("id") % 4 == 0)


_WIDE = "id, page, cx, cy, cx - 30 AS x0, cy - 30 AS y0, cx + 30 AS x1, cy + 30 AS y1"
_SUPP = """NOT EXISTS (SELECT 1 FROM x WHERE x.page = d.page AND (x.tag <> '' AND d.tag <> '' AND x.tag = d.tag
  OR x.tag = '' AND d.tag = '' AND sqrt((x.cx - d.cx) * (x.cx - d.cx) + (x.cy - d.cy) * (x.cy - d.cy)) <= 30))"""


def wide(t, where, tag):
    return t.L_box.filter(where).selectExpr("id", "page", "cx", "cy", "cx - 30 AS x0", "cy - 30 AS y0", "cx + 30 AS x1", "cy + 30 AS y1", f"{tag} AS tag")


@query("M3", f"""
WITH d AS (SELECT {_WIDE}, CASE WHEN id % 4 < 2 THEN 'T' || (id % 13) ELSE '' END AS tag FROM L_box WHERE id % 7 <> 0),
x AS (SELECT {_WIDE}, CASE WHEN id % 2 = 0 THEN 'T' || (id % 13) ELSE '' END AS tag FROM L_box WHERE id % 7 = 0),
ty AS (SELECT id, page, cx, cy, CASE WHEN id % 5 = 0 THEN 'T' || (id % 13) ELSE '' END AS tag, 'K' || (id % 4) AS kind FROM L_box WHERE id % 6 = 1),
k AS (SELECT * FROM d WHERE page % 3 <> 2 AND {_SUPP} QUALIFY row_number() OVER (PARTITION BY page, tag ORDER BY id) = 1),
bt AS (SELECT page, tag, arg_max(kind, id) AS kind FROM ty WHERE tag <> '' GROUP BY ALL),
near AS (SELECT k.id, arg_min(ty.kind, ty.id) AS kind FROM k JOIN ty ON ty.page = k.page AND ty.tag = '' AND k.tag = '' AND abs(k.cx - ty.cx) <= 30 AND abs(k.cy - ty.cy) <= 30 GROUP BY k.id)
SELECT k.id, k.page, k.tag, coalesce(bt.kind, near.kind, 'single') AS kind FROM k LEFT JOIN bt ON bt.page = k.page AND bt.tag = k.tag AND k.tag <> '' LEFT JOIN near ON near.id = k.id""")
def m3(t):
    d = wide(t, "id % 7 <> 0", "IF(id % 4 < 2, concat('T', id % 13), '')").withColumn("kind", F.lit("single"))
    dead = wide(t, "id % 7 = 0", "IF(id % 2 = 0, concat('T', id % 13), '')")
    sheets = t.L_box.filter("page % 3 <> 2").select("page").distinct()
    typed = t.L_box.filter("id % 6 = 1").selectExpr("id AS typed_id", "page", "cx", "cy", "IF(id % 5 = 0, concat('T', id % 13), '') AS tag", "concat('K', id % 4) AS kind")
    return mg.save_audit(d, sheets, dead, typed, ["page"], 30.0).select("id", "page", "tag", "kind")


@query("M4", f"""
WITH c AS (SELECT {_WIDE}, 'T' || (id % 13) AS tag, id % 2 = 0 AS is_primary FROM L_box WHERE id % 3 = 0), f AS (SELECT {_WIDE}, 'T' || (id % 13) AS tag, id % 4 = 0 AS is_primary FROM L_box WHERE id % 3 = 1),
x AS (SELECT {_WIDE}, 'T' || (id % 13) AS tag FROM L_box WHERE id % 3 = 2 AND id % 10 = 0), hand AS (SELECT DISTINCT page, 'T' || (id % 13) AS tag FROM L_box WHERE id % 3 = 2 AND id % 10 = 3),
r AS (SELECT page, cx - 150 AS x0, cy - 150 AS y0, cx + 150 AS x1, cy + 150 AS y1 FROM L_box WHERE id % 40 = 1),
gone AS (SELECT id FROM c WHERE page % 2 = 0 AND CAST(substr(tag, 2) AS INT) < 9 AND EXISTS (SELECT 1 FROM r WHERE r.page = c.page AND c.cx BETWEEN r.x0 AND r.x1 AND c.cy BETWEEN r.y0 AND r.y1)),
fresh AS (SELECT * FROM f d WHERE {_SUPP} AND (page, tag) NOT IN (SELECT page, tag FROM hand) QUALIFY row_number() OVER (PARTITION BY page, tag ORDER BY id) = 1),
p AS (SELECT DISTINCT tag FROM fresh WHERE is_primary)
SELECT id, page, tag, is_primary AND tag NOT IN (SELECT tag FROM p) AS is_primary, CASE WHEN is_primary AND tag IN (SELECT tag FROM p) THEN 'demoted' ELSE 'kept' END AS what FROM c WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT id, page, tag, is_primary, 'added' FROM fresh""")
def m4(t):
    tag = "concat('T', id % 13)"
    c = wide(t, "id % 3 = 0", tag).withColumn("is_primary", F.expr("id % 2 = 0"))
    f = wide(t, "id % 3 = 1", tag).withColumn("is_primary", F.expr("id % 4 = 0"))
    dead, hand = wide(t, "id % 3 = 2 AND id % 10 = 0", tag), wide(t, "id % 3 = 2 AND id % 10 = 3", tag)
    regions = t.L_box.filter("id % 40 = 1").selectExpr("page", "cx - 150 AS x0", "cy - 150 AS y0", "cx + 150 AS x1", "cy + 150 AS y1")
    pages = t.L_box.filter("page % 2 = 0").select("page").distinct()
    tags = t.L_box.filter("id % 13 < 9").select(F.expr(tag).alias("tag")).distinct()
    return mg.save_reprocess(c, f, pages, tags, regions, dead, hand, 64.0, 30.0).select("id", "page", "tag", "is_primary", "what")


@query("M5", f"""
WITH l AS (SELECT {_WIDE} FROM L_box WHERE id % 3 = 0), c AS (SELECT {_WIDE} FROM L_box WHERE id % 9 = 1)
SELECT id, page FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = l.page AND c.x0 < l.x1 AND l.x0 < c.x1 AND c.y0 < l.y1 AND l.y0 < c.y1)
UNION ALL SELECT id, page FROM L_box WHERE id % 9 = 2""")
def m5(t):
    cols = ["id", "page", "x0", "y0", "x1", "y1"]
    return mg.record_unread(wide(t, "id % 3 = 0", "tag").select(*cols), wide(t, "id % 9 = 1", "tag").select("page", "x0", "y0", "x1", "y1"),
                            wide(t, "id % 9 = 2", "tag").select(*cols), 64.0).select("id", "page")


@query("M6", """
WITH w AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS VARCHAR) AS door_tag, arg_max('W' || (l_suppkey % 6), l_partkey * 100000 + l_suppkey) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT d.document_id, d.door_tag, d.row_index, coalesce(w, d.door_material) AS wall_type FROM L_doors d LEFT JOIN w USING (document_id, door_tag)""")
def m6(t):
    doors = t.L_doors.select("document_id", "door_tag", "row_index", F.col("door_material").alias("wall_type"))
    walls = t.lineitem.filter("l_returnflag = 'R'").selectExpr("l_orderkey AS document_id", "CAST(l_linenumber AS STRING) AS door_tag", "concat('W', l_suppkey % 6) AS wall_type", "l_partkey * 100000 + l_suppkey AS id")
    return mg.record_walls(doors, walls)


@query("M7", """
WITH a AS (SELECT DISTINCT user_id AS document_id, CAST(event_id % 9 + 1 AS VARCHAR) AS door_tag FROM events), w AS (SELECT document_id, door_tag, arg_min(door_width, row_index) AS was FROM L_doors GROUP BY 1, 2)
SELECT a.document_id, a.door_tag, w.door_tag IS NOT NULL AS known, was FROM a LEFT JOIN w USING (document_id, door_tag)""")
def m7(t):
    asked = t.events.selectExpr("user_id AS document_id", "CAST(event_id % 9 + 1 AS STRING) AS door_tag")
    known, unknown = mg.correct_many(t.L_doors, asked, "door_width")
    return (known.select("document_id", "door_tag", F.lit(True).alias("known"), "was")
            .unionByName(unknown.select("document_id", "door_tag", F.lit(False).alias("known"), F.lit(None).cast("string").alias("was"))))


@query("M8", """
WITH placed AS (SELECT DISTINCT user_id AS document_id, CAST(event_id % 9 + 1 AS VARCHAR) AS door_tag FROM events),
n AS (SELECT * FROM placed WHERE (document_id, door_tag) NOT IN (SELECT document_id, door_tag FROM L_doors)),
m AS (SELECT document_id, max(row_index) AS mx FROM L_doors GROUP BY 1)
SELECT 'new' AS what, n.document_id, door_tag, coalesce(mx, -1) + row_number() OVER (PARTITION BY n.document_id ORDER BY door_tag) AS row_index FROM n LEFT JOIN m USING (document_id)
UNION ALL SELECT 'kept', document_id, door_tag, row_index FROM L_doors d WHERE source <> 'plan' OR (document_id, door_tag) IN (SELECT document_id, door_tag FROM placed)""")
def m8(t):
    placed = t.events.selectExpr("user_id AS document_id", "CAST(event_id % 9 + 1 AS STRING) AS door_tag")
    new, kept = mg.ensure_doors(t.L_doors, placed), mg.drop_orphans(t.L_doors, placed)
    cols = ["document_id", "door_tag", "row_index"]
    return new.select(F.lit("new").alias("what"), *cols).unionByName(kept.select(F.lit("kept").alias("what"), *cols))


@query("M9", """SELECT d.id, d.project_id, CASE WHEN p.id IS NOT NULL THEN p.status ELSE d.status END AS status FROM L_docs d LEFT JOIN (SELECT * FROM L_projects WHERE id % 4 = 0) p ON p.id = d.project_id""")
def m9(t):
    return mg.set_project_status(t.L_docs, t.L_projects.filter("id % 4 = 0")).select("id", "project_id", "status")


@query("M10", """
SELECT 'stay' AS what, id, x0, CASE WHEN id % 6 = 3 THEN 'pocket' ELSE 'single' END AS kind, NULL AS hinge_x FROM L_box WHERE id % 3 <> 1
UNION ALL SELECT 'tomb', id, x0, NULL, NULL FROM L_box WHERE id % 3 = 1
UNION ALL SELECT 'placed', id, x0 + 7, CASE WHEN id % 2 = 0 THEN 'double' ELSE 'single' END, cx + 7 FROM L_box WHERE id % 3 = 1""")
def m10(t):
    boxes = t.L_box.selectExpr("id", "page", "tag", "x0", "y0", "x1", "y1", "'single' AS kind", "cx AS hinge_x", "cy AS hinge_y")
    patches = t.L_box.filter("id % 3 <> 2").selectExpr("id", "IF(id % 3 = 1, x0 + 7, x0 + 0.00001D) AS x0", "y0", "IF(id % 3 = 1, x1 + 7, x1) AS x1", "y1",
                                                        "CASE WHEN id % 6 = 3 THEN 'pocket' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'double' END AS kind")
    stay, tomb, placed = mg.move_boxes(boxes, patches)
    return (stay.select(F.lit("stay").alias("what"), "id", "x0", "kind", F.lit(None).cast("double").alias("hinge_x"))
            .unionByName(tomb.select(F.lit("tomb").alias("what"), "id", "x0", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("hinge_x")))
            .unionByName(placed.select(F.lit("placed").alias("what"), "id", "x0", "kind", "hinge_x")))


@query("M11", """
WITH g AS (SELECT id FROM L_docs WHERE status = 'archived')
SELECT 'doors' AS tbl, document_id, count(*) AS n FROM L_doors WHERE document_id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'corrections', document_id, count(*) FROM L_corr WHERE document_id NOT IN (SELECT id FROM g) GROUP BY 2""")
def m11(t):
    left = mg.delete_documents(t.L_docs.filter("status = 'archived'"), {"doors": t.L_doors, "corrections": t.L_corr})
    out = [df.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("tbl"), "document_id", "n") for k, df in left.items()]
    return out[0].unionByName(out[1])


@query("M12", """
SELECT document_id, door_tag, row_index, CASE WHEN door_material <> '' AND suppkey % 3 > 0 THEN 'door_material=' || door_material ELSE '' END || CASE WHEN suppkey % 3 = 0 THEN 'door_material=old' ELSE '' END
  || ';door_type=' || door_type AS extra FROM L_doors""")
def m12(t):
    doors = t.L_doors.selectExpr("document_id", "door_tag", "row_index", "door_material", "door_type", "IF(suppkey % 3 = 0, map('door_material', 'old'), CAST(map() AS MAP<STRING, STRING>)) AS extra")
    out = mg.fold_missing(doors, ["document_id", "door_tag", "row_index"])
    return out.select("document_id", "door_tag", "row_index", F.concat(
        F.coalesce(F.concat(F.lit("door_material="), F.element_at("extra", "door_material")), F.lit("")), F.lit(";door_type="), F.element_at("extra", "door_type")).alias("extra"))


@query("M13", """
SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'second' ELSE 'first' END ELSE 'none' END AS parts, id % 4 = 0 OR id % 5 = 0 AS verified,
  CAST(CASE WHEN id % 8 = 0 THEN list_price + 10 ELSE list_price END AS DOUBLE) AS list_price FROM L_price""")
def m13(t):
    prices = t.L_price.selectExpr("id", "list_price", "id % 5 = 0 AS verified", "'none' AS parts",
                                  "array(named_struct('total', CAST(list_price AS DECIMAL(13,2)), 'parts', 'first'), named_struct('total', CAST(list_price + 10 AS DECIMAL(13,2)), 'parts', 'second')) AS answers")
    patches = t.L_price.filter("id % 4 = 0").selectExpr("id", "CAST(IF(id % 8 = 0, list_price + 10, list_price) AS DECIMAL(13,2)) AS list_price")
    return mg.confirm(prices, patches).select("id", "parts", "verified", F.col("list_price").cast("double").alias("list_price"))


@query("M14", """
SELECT user_id AS document_id, count(DISTINCT CASE WHEN event_id % 5 > 0 THEN 'T' || (event_id % 17) END) AS doors_located, count(*) FILTER (WHERE event_id % 2 = 0 AND value > 10) AS swings_measured, count(*) AS detections FROM events GROUP BY 1""")
def m14(t):
    return mg.log_run(t.events.selectExpr("user_id AS document_id", "IF(event_id % 5 > 0, concat('T', event_id % 17), '') AS tag", "event_id % 2 = 0 AS is_primary", "value > 10 AS has_arc"))


# A third of the documents lose their table R; in a fifth every door names one table, and in some of those the rows do not add up.
_RM = """d AS (SELECT document_id, door_tag, door_type AS own, CASE WHEN document_id % 5 = 0 THEN 'A' ELSE door_type END AS schedule_id, row_number() OVER (PARTITION BY document_id ORDER BY door_type, row_index) - 1 AS row_index FROM L_doors),
b AS (SELECT document_id, door_tag, suppkey % 6 = 0 AS by_hand FROM L_doors WHERE partkey % 2 = 0),
s AS (SELECT document_id, own AS schedule_id, CAST(ascii(own) AS INT) AS page, 'Door  schedule ' || own AS title, count(*) + CASE WHEN document_id % 10 = 0 AND own = 'R' THEN 1 ELSE 0 END AS row_count FROM d GROUP BY 1, 2),
w AS (SELECT id AS document_id, 'R' AS schedule_id FROM L_docs WHERE id % 3 = 0 AND (id, 'R') IN (SELECT document_id, schedule_id FROM s)),
c AS (SELECT document_id FROM s WHERE document_id % 5 = 0 GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT * FROM w WHERE document_id IN (SELECT document_id FROM c) AND document_id % 10 = 0), g AS (SELECT * FROM w WHERE document_id NOT IN (SELECT document_id FROM f)),
m AS (SELECT d.*, g.document_id IS NOT NULL AS goes FROM d LEFT JOIN g ON g.document_id = d.document_id AND g.schedule_id = CASE WHEN d.document_id IN (SELECT document_id FROM c) THEN d.own ELSE d.schedule_id END),
lost AS (SELECT document_id, door_tag FROM m GROUP BY ALL HAVING bool_and(goes))"""


@query("M15", f"""WITH {_RM} SELECT 'door' AS what, document_id, count(*) AS n FROM m WHERE NOT goes GROUP BY 2
UNION ALL SELECT 'box', document_id, count(*) FROM b WHERE by_hand OR (document_id, door_tag) NOT IN (SELECT * FROM lost) GROUP BY 2
UNION ALL SELECT 'hand', document_id, count(DISTINCT door_tag) FROM b WHERE by_hand AND (document_id, door_tag) IN (SELECT * FROM lost) GROUP BY 2
UNION ALL SELECT 'refused', document_id, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'read again', document_id, count(*) FROM s WHERE (document_id, schedule_id) NOT IN (SELECT * FROM g) GROUP BY 2""")
def m15(t):
    from pyspark.sql import Window as W

    row = F.row_number().over(W.partitionBy("document_id").orderBy("door_type", "row_index")) - 1
    d = t.L_doors.select("document_id", "door_tag", F.col("door_type").alias("own"), row.cast("bigint").alias("row_index"))
    doors = d.selectExpr("document_id", "door_tag", "CASE WHEN document_id % 5 = 0 THEN 'A' ELSE own END AS schedule_id", "row_index", "'schedule' AS source")
    s = (d.groupBy("document_id", F.col("own").alias("schedule_id")).agg(F.count(F.lit(1)).alias("row_count"))
         .selectExpr("document_id", "schedule_id", "ascii(schedule_id) AS page", "concat('Door  schedule ', schedule_id) AS title", "row_count + IF(document_id % 10 = 0 AND schedule_id = 'R', 1, 0) AS row_count"))
    boxes = t.L_doors.filter("partkey % 2 = 0").selectExpr("document_id", "door_tag", "suppkey % 6 = 0 AS by_hand")
    out = mg.remove_schedules(s, doors, boxes, t.L_docs.filter("id % 3 = 0").selectExpr("id AS document_id", "'R' AS schedule_id"))
    # The next reading prints its titles in another way; what was removed stays out of it.
    again = tb.leave_out_removed(s.withColumn("title", F.upper("title")), out.removed, ["document_id"])
    parts = (("door", out.doors), ("box", out.boxes), ("hand", out.hand_placed), ("refused", out.refused), ("read again", again))
    return reduce(DataFrame.unionByName, [p.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "document_id", "n") for what, p in parts])


@query("M16", """
WITH o AS (SELECT CAST(id AS VARCHAR) AS id, code, name FROM L_projects WHERE id % 2 = 0), w AS (SELECT DISTINCT code, name FROM L_projects WHERE id % 3 = 0)
SELECT id, code, name FROM o UNION ALL SELECT sha256(code || '/' || name), code, name FROM w WHERE (code, name) NOT IN (SELECT code, name FROM o)""")
def m16(t):
    old = t.L_projects.filter("id % 2 = 0").select(F.col("id").cast("string").alias("id"), "code", "name")
    return mg.ensure(old, t.L_projects.filter("id % 3 = 0"), ["code", "name"], F.sha2(F.concat_ws("/", "code", "name"), 256)).select("id", "code", "name")


@query("M17", f"""
WITH {_CODES}, c AS (SELECT 'C' || k AS code, b AS manufacturer, k % 3 = 0 AS no_book FROM brands)
SELECT code, c.manufacturer, no_book, (m.manufacturer IS NOT NULL) <> no_book AS accepted FROM c LEFT JOIN makers m ON m.manufacturer = c.manufacturer""")
def m17(t):
    b = brands(t)
    return mg.put_codes(b.selectExpr("concat('C', k) AS code", "b AS manufacturer", "k % 3 = 0 AS no_book"), b.filter("k <= 15").select(F.col("b").alias("manufacturer"))).select(
        "code", "manufacturer", "no_book", "accepted")


@query("M18", """
WITH o AS (SELECT doc AS document_id, page, min(number) AS number FROM L_title WHERE id % 3 < 2 GROUP BY ALL), n AS (SELECT doc AS document_id, page, min(title) AS number FROM L_title WHERE id % 3 > 0 GROUP BY ALL)
SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.page, n.page) AS page, coalesce(n.number, o.number) AS number FROM o FULL JOIN n ON o.document_id = n.document_id AND o.page = n.page""")
def m18(t):
    old = t.L_title.filter("id % 3 < 2").groupBy(F.col("doc").alias("document_id"), "page").agg(F.min("number").alias("number"))
    new = t.L_title.filter("id % 3 > 0").groupBy(F.col("doc").alias("document_id"), "page").agg(F.min("title").alias("number"))
    return mg.record_pages(old, new)


@query("M19", """
SELECT page AS document_id, count(*) AS n, page % 2 = 0 AS cleared FROM L_box WHERE id % 7 = 0 GROUP BY page""")
def m19(t):
    tomb = t.L_box.filter("id % 7 = 0").selectExpr("page AS document_id", "id")
    left, cleared = mg.clear_suppressions(tomb, t.L_box.filter("page % 2 = 0").selectExpr("page AS document_id"))
    return (left.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("cleared", F.lit(False))
            .unionByName(cleared.select("document_id", F.col("cleared").alias("n"), F.lit(True).alias("cleared"))))
