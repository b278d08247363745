"""Overlay, summary, lookup and ranking queries."""

from pyspark.sql import Window as W, functions as F

from mullion.operators import overlay
from mullion.registry import query

CURRENT_SQL = """
WITH newest AS (
  SELECT DISTINCT ON (document_id, door_tag, field) document_id, door_tag, field, now_value, created_at
  FROM L_corr ORDER BY document_id, door_tag, field, created_at DESC, id DESC),
applied AS (
  SELECT document_id, door_tag, max(created_at) AS edited_at, count(*) AS n_fixes,
         max(CASE WHEN field = 'door_width' THEN now_value END) AS w,
         max(CASE WHEN field = 'door_height' THEN now_value END) AS h,
         max(CASE WHEN field = 'door_type' THEN now_value END) AS t,
         max(CASE WHEN field = 'door_material' THEN now_value END) AS m
  FROM newest WHERE now_value IS NOT NULL GROUP BY document_id, door_tag)
"""


@query("J1", CURRENT_SQL + """
SELECT d.document_id, d.door_tag, d.level, d.row_index, coalesce(w, door_width) AS width,
       coalesce(h, door_height) AS height, coalesce(t, door_type) AS type, coalesce(m, door_material) AS material,
       n_fixes IS NOT NULL AS edited, CAST(edited_at AS VARCHAR) AS edited_at,
       coalesce(n_fixes, 0) AS n_fixes
FROM L_doors d LEFT JOIN applied a ON a.document_id = d.document_id AND a.door_tag = d.door_tag""")
def j1(t):
    df = overlay.doors_current(t.L_doors, t.L_corr)
    return df.select("document_id", "door_tag", "level", "row_index", "width", "height", "type", "material", "edited",
                     F.col("edited_at").cast("string").alias("edited_at"),
                     F.size("corrected").cast("bigint").alias("n_fixes"))


@query("J28", CURRENT_SQL + """
SELECT d.document_id, d.door_tag, d.level, d.row_index, coalesce(w, door_width) AS door_width,
       coalesce(h, door_height) AS door_height, coalesce(t, door_type) AS door_type,
       coalesce(m, door_material) AS door_material, source
FROM L_doors d LEFT JOIN applied a ON a.document_id = d.document_id AND a.door_tag = d.door_tag""")
def j28(t):
    fields = ["door_width", "door_height", "door_type", "door_material"]
    return overlay.effective_doors(t.L_doors, t.L_corr, fields).select(
        "document_id", "door_tag", "level", "row_index", *fields, "source")


@query("J2", """
SELECT r.id, p.name AS project, d.filename, r.kind, r.status, r.doors_scheduled, r.doors_located,
       CASE WHEN coalesce(r.doors_scheduled, 0) > 0
            THEN CAST(round(CAST(100.0 * r.doors_located / r.doors_scheduled AS DECIMAL(20,6)), 0) AS BIGINT) END AS located_pct,
       CAST(r.cost_usd AS DOUBLE) AS cost_usd
FROM L_runs r LEFT JOIN L_docs d ON d.id = r.document_id LEFT JOIN L_projects p ON p.id = r.project_id""")
def j2(t):
    return overlay.run_scorecard(t.L_runs, t.L_docs, t.L_projects).withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query("J3", """
WITH per_document AS (
  SELECT doc.id, doc.project_id, doc.created_at,
         (SELECT count(*) FROM L_doors dr WHERE dr.document_id = doc.id) AS doors,
         (SELECT count(*) FROM L_doors det WHERE det.document_id = doc.id AND det.level = 'F' AND det.door_type = 'R') AS swings
  FROM L_docs doc),
rolled AS (SELECT project_id, count(*) AS documents, sum(doors) AS doors, sum(swings) AS swings, max(created_at) AS last_upload
           FROM per_document GROUP BY project_id),
corrected AS (SELECT doc.project_id, count(DISTINCT c.door_tag) AS n FROM L_corr c JOIN L_docs doc ON doc.id = c.document_id
              GROUP BY doc.project_id),
spend AS (SELECT project_id, sum(cost_usd) AS usd FROM L_runs GROUP BY project_id)
SELECT p.id, p.name, p.code, p.status, coalesce(documents, 0) AS documents, CAST(coalesce(doors, 0) AS BIGINT) AS doors,
       CAST(coalesce(swings, 0) AS BIGINT) AS swings_measured, coalesce(n, 0) AS doors_corrected,
       CAST(coalesce(usd, 0) AS DOUBLE) AS spent_usd, CAST(last_upload AS VARCHAR) AS last_upload
FROM L_projects p LEFT JOIN rolled r ON r.project_id = p.id LEFT JOIN corrected x ON x.project_id = p.id
LEFT JOIN spend s ON s.project_id = p.id""")
def j3(t):
    swings = t.L_doors.filter("level = 'F' AND door_type = 'R'")
    return (overlay.project_summary(t.L_projects, t.L_docs, t.L_doors, swings, t.L_corr, t.L_runs)
            .withColumn("spent_usd", F.col("spent_usd").cast("double"))
            .withColumn("last_upload", F.col("last_upload").cast("string")))


@query("A1", """
SELECT d.project_id, count(DISTINCT d.id) AS documents, count(l.document_id) AS doors,
       count(CASE WHEN l.level = 'F' AND l.door_type = 'R' THEN 1 END) AS swings_measured,
       CAST(max(d.created_at) AS VARCHAR) AS last_upload
FROM L_docs d LEFT JOIN L_doors l ON l.document_id = d.id GROUP BY d.project_id""")
def a1(t):
    swings = t.L_doors.filter("level = 'F' AND door_type = 'R'")
    return overlay.rolled(overlay.per_document(t.L_docs, t.L_doors, swings)).withColumn(
        "last_upload", F.col("last_upload").cast("string"))


@query("A2", """
SELECT d.project_id, count(DISTINCT c.door_tag) AS doors_corrected
FROM L_corr c JOIN L_docs d ON d.id = c.document_id GROUP BY d.project_id""")
def a2(t):
    return overlay.corrected_doors(t.L_corr, t.L_docs)


@query("A3", """
SELECT p.id, CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS spent_usd
FROM L_projects p LEFT JOIN L_runs r ON r.project_id = p.id GROUP BY p.id""")
def a3(t):
    return (t.L_projects.select("id").join(overlay.spend(t.L_runs).withColumnRenamed("project_id", "id"), "id", "left")
            .select("id", F.coalesce(F.col("spent_usd").cast("double"), F.lit(0.0)).alias("spent_usd")))


@query("A4", """
SELECT document_id, count(*) AS doors, count(*) FILTER (WHERE level = 'F' AND door_type = 'R') AS measured
FROM L_doors GROUP BY document_id""")
def a4(t):
    return t.L_doors.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("doors"),
        F.count(F.when((F.col("level") == "F") & (F.col("door_type") == "R"), 1)).alias("measured"))


@query("A5", """
WITH newest AS (
  SELECT DISTINCT ON (document_id, door_tag, field) document_id, door_tag, field, now_value, created_at
  FROM L_corr ORDER BY document_id, door_tag, field, created_at DESC, id DESC)
SELECT document_id, door_tag, string_agg(field || '=' || now_value, ',' ORDER BY field) AS fixes,
       CAST(max(created_at) AS VARCHAR) AS edited_at
FROM newest WHERE now_value IS NOT NULL GROUP BY document_id, door_tag""")
def a5(t):
    return overlay.applied_fixes(t.L_corr).select(
        "document_id", "door_tag",
        F.expr("array_join(transform(array_sort(map_entries(fixes)), e -> concat(e.key, '=', e.value)), ',')").alias("fixes"),
        F.col("edited_at").cast("string").alias("edited_at"))


@query("A6", """
SELECT id, CASE WHEN doors_scheduled > 0
   THEN CAST(round(CAST(100.0 * doors_located / doors_scheduled AS DECIMAL(20,6)), 0) AS BIGINT) END AS located_pct FROM L_runs""")
def a6(t):
    return t.L_runs.select("id", overlay.located_pct(F.col("doors_located"), F.col("doors_scheduled")).alias("located_pct"))


@query("W1", """
SELECT DISTINCT ON (document_id, door_tag, field) document_id, door_tag, field, now_value, id
FROM L_corr ORDER BY document_id, door_tag, field, created_at DESC, id DESC""")
def w1(t):
    return overlay.latest(t.L_corr, ["document_id", "door_tag", "field"], ["created_at", "id"]).select(
        "document_id", "door_tag", "field", "now_value", "id")


@query("W2", """
SELECT document_id, kind, id, status FROM L_jobs
QUALIFY row_number() OVER (PARTITION BY document_id, kind ORDER BY updated_at DESC, id DESC) = 1""")
def w2(t):
    return overlay.latest(t.L_jobs, ["document_id", "kind"], ["updated_at", "id"]).select("document_id", "kind", "id", "status")


@query("W3", """
WITH d AS (SELECT id, tag, page, residual < 0.08 AS has_arc, radius AS scale FROM L_box),
p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY has_arc DESC, scale DESC, page, id) AS rn FROM d)
SELECT p.id, p.tag, p.page, p.rn = 1 AS is_primary, q.page AS counted_on,
       (SELECT string_agg(CAST(o.page AS VARCHAR), ',' ORDER BY o.scale, o.page) FROM d o WHERE o.tag = p.tag) AS also_on
FROM p JOIN p q ON q.tag = p.tag AND q.rn = 1""")
def w3(t):
    det = t.L_box.selectExpr("id", "tag", "page", "residual < 0.08 AS has_arc", "radius AS scale")
    return overlay.elect_primary(det, ["tag"]).select(
        "id", "tag", "page", "is_primary", "counted_on", F.array_join("also_on", ",").alias("also_on"))


@query("W6", """
SELECT document_id, door_tag, level, row_index, door_width, true AS kept, CAST(1 AS BIGINT) AS seen FROM L_doors
QUALIFY row_number() OVER (PARTITION BY document_id, door_tag, level ORDER BY row_index, partkey, door_width, door_height, door_type) = 1
UNION ALL
SELECT document_id, door_tag, level, NULL, NULL, false, count(*) FROM L_doors GROUP BY ALL HAVING count(*) > 1""")
def w6(t):
    kept, repeats = overlay.first_per_door(t.L_doors, ["row_index", "partkey", "door_width", "door_height", "door_type"])
    cols = ["document_id", "door_tag", "level"]
    return (kept.select(*cols, "row_index", "door_width", F.lit(True).alias("kept"), F.lit(1).cast("bigint").alias("seen"))
            .unionByName(repeats.select(*cols, "seen", F.lit(False).alias("kept")), allowMissingColumns=True))


@query("W7", """
SELECT document_id, door_tag, level, row_index FROM L_doors
QUALIFY row_number() OVER (PARTITION BY document_id, door_tag ORDER BY level, row_index) = 1""")
def w7(t):
    return overlay.earliest(t.L_doors, ["document_id", "door_tag"], ["level", "row_index"]).select(
        "document_id", "door_tag", "level", "row_index")


@query("P1", """
SELECT id, project_id, filename, status = 'archived' AS archived FROM L_docs""")
def p1(t):
    live, hidden = (t.L_docs.filter(F.col("status") == s) for s in ("active", "archived"))
    cols = ["id", "project_id", "filename"]
    return live.select(*cols, F.lit(False).alias("archived")).unionByName(hidden.select(*cols, F.lit(True).alias("archived")))


@query("P2", """
SELECT id, match_key, manufacturer FROM L_price WHERE match_key LIKE 'RED%' AND kind = 'base'""")
def p2(t):
    return t.L_price.filter(F.col("match_key").startswith("RED") & (F.col("kind") == "base")).select(
        "id", "match_key", "manufacturer")


@query("P3", """
SELECT id, manufacturer, match_key FROM L_price
WHERE (manufacturer, size) IN (SELECT DISTINCT manufacturer, size FROM L_items WHERE quantity = 50)""")
def p3(t):
    keys = t.L_items.filter("quantity = 50").select("manufacturer", "size").distinct()
    return t.L_price.join(keys, ["manufacturer", "size"], "left_semi").select("id", "manufacturer", "match_key")


@query("P30", """
SELECT id, document_id, field, field IN ('door_width','door_height','door_type','door_material') AS accepted FROM L_corr""")
def p30(t):
    # The correctable columns present in this lens.
    ok = ["door_width", "door_height", "door_type", "door_material"]
    return t.L_corr.select("id", "document_id", "field", F.col("field").isin(ok).alias("accepted"))


_DET = "SELECT id, page, tag, x0, y0, x1, y1, radius, 'measured' AS source, CAST(NULL AS VARCHAR) AS note FROM L_box WHERE is_door"
_MAN = "SELECT id, page, tag, x0, y0, x1, y1, NULL, 'manual', 'placed ' || tag FROM L_box WHERE NOT is_door"


def all_detections(t):
    det = t.L_box.filter("is_door").select("id", "page", "tag", F.struct("x0", "y0", "x1", "y1").alias("box"),
                                           F.struct("radius").alias("arc"), F.lit("measured").alias("source"))
    man = t.L_box.filter("NOT is_door").select("id", "page", "tag", F.struct("x0", "y0", "x1", "y1").alias("box"),
                                               F.lit("manual").alias("source"), F.concat(F.lit("placed "), "tag").alias("note"))
    return det.unionByName(man, allowMissingColumns=True).select("id", "page", "tag", "box.*", "arc.radius", "source", "note")


@query("P20", f"{_DET} UNION ALL {_MAN}")
def p20(t):
    return all_detections(t)


@query("U1", f"SELECT page, source, count(*) AS n, count(radius) AS with_arc FROM ({_DET} UNION ALL {_MAN}) GROUP BY page, source")
def u1(t):
    return all_detections(t).groupBy("page", "source").agg(F.count(F.lit(1)).alias("n"), F.count("radius").alias("with_arc"))


@query("U2", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49)
SELECT 'fresh' AS part, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'shared', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def u2(t):
    a = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    b = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    return (a.subtract(b).select(F.lit("fresh").alias("part"), "k")
            .unionByName(a.intersect(b).select(F.lit("shared").alias("part"), "k")))


@query("O1", "SELECT id, project_id, CAST(created_at AS VARCHAR) AS created_at FROM L_docs ORDER BY created_at DESC, id DESC")
def o1(t):
    return t.L_docs.orderBy(F.desc("created_at"), F.desc("id")).select(
        "id", "project_id", F.col("created_at").cast("string").alias("created_at"))


@query("O3", """
SELECT project_id, id, filename, rn FROM (
  SELECT project_id, id, filename, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS rn FROM L_docs)
WHERE rn <= 3""")
def o3(t):
    return top_k(t.L_docs.select("project_id", F.struct(-F.unix_micros("created_at"), "id", "filename").alias("r")),
                 "project_id", 3).select("project_id", "r.id", "r.filename", "rn")


def top_k(df, key, k):
    """Smallest k structs per key: ranked within salted parts, then across them."""
    part = F.pmod(F.xxhash64("r"), F.lit(64))
    first = df.withColumn("rn", F.row_number().over(W.partitionBy(key, part).orderBy("r"))).filter(F.col("rn") <= k)
    return first.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("r")).cast("bigint")).filter(F.col("rn") <= k)


@query("O5", """
SELECT id, manufacturer, match_key, CAST(list_price AS DOUBLE) AS list_price, id % 3 = 0 AS verified
FROM L_price WHERE kind <> 'option_add' ORDER BY id % 3 = 0 DESC, match_key, id""")
def o5(t):
    return (t.L_price.filter("kind <> 'option_add'").withColumn("verified", F.expr("id % 3 = 0"))
            .orderBy(F.desc("verified"), "match_key", "id")
            .select("id", "manufacturer", "match_key", F.col("list_price").cast("double").alias("list_price"), "verified"))


@query("O6", """
WITH hit AS (SELECT id, match_key FROM L_price WHERE starts_with(match_key, 'BLUE') AND kind = 'base'),
page AS (SELECT * FROM hit ORDER BY match_key, id LIMIT 25)
SELECT id, match_key, (SELECT count(*) > 25 FROM (SELECT 1 FROM hit LIMIT 26)) AS more FROM page""")
def o6(t):
    n = 25
    hit = t.L_price.filter(F.col("match_key").startswith("BLUE") & (F.col("kind") == "base")).select("id", "match_key")
    page = hit.orderBy("match_key", "id").limit(n + 1)  # at most 26 rows from here on
    return (page.withColumn("rn", F.row_number().over(W.orderBy("match_key", "id")))
            .withColumn("more", F.max("rn").over(W.partitionBy()) > n)
            .filter(F.col("rn") <= n).select("id", "match_key", "more"))


@query("O8", """
SELECT document_id, id, kind, CAST(created_at AS VARCHAR) AS created_at FROM L_runs WHERE document_id = 70
ORDER BY created_at DESC, id DESC""")
def o8(t):
    return t.L_runs.filter("document_id = 70").orderBy(F.desc("created_at"), F.desc("id")).select(
        "document_id", "id", "kind", F.col("created_at").cast("string").alias("created_at"))


@query("A33", """
SELECT 'document_id' AS column, bool_or(CAST(document_id AS VARCHAR) <> '') AS filled FROM L_doors
UNION ALL SELECT 'door_tag', bool_or(door_tag <> '') FROM L_doors
UNION ALL SELECT 'door_material', bool_or(door_material <> '') FROM L_doors
UNION ALL SELECT 'hw_set', false
UNION ALL SELECT 'door_type', bool_or(door_type <> '') FROM L_doors""")
def a33(t):
    cols = ["document_id", "door_tag", "door_material", "hw_set", "door_type"]
    df = t.L_doors.withColumn("hw_set", F.lit("")).withColumn("document_id", F.col("document_id").cast("string"))
    return overlay.fields_filled(df, cols)


@query("A21", """
WITH n AS (SELECT document_id, count(*) AS rows, count(nullif(door_material, '')) AS numbered,
                  count(CASE WHEN source = 'schedule' THEN 1 END) AS placed FROM L_doors GROUP BY document_id)
SELECT document_id, rows, CASE WHEN numbered * 100 < rows * 80 THEN 'numbers' WHEN placed * 100 < rows * 60 THEN 'placed' END AS review
FROM n""")
def a21(t):
    n = t.L_doors.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.nullif("door_material", F.lit(""))).alias("numbered"),
        F.count(F.when(F.col("source") == "schedule", 1)).alias("placed"))
    return n.select("document_id", "rows",
                    F.when(F.col("numbered") * 100 < F.col("rows") * 80, "numbers")
                    .when(F.col("placed") * 100 < F.col("rows") * 60, "placed").alias("review"))
