"""Sources and sinks."""

import os
import uuid

from pyspark.sql import functions as F

from mullion.operators import overlay, replies
from mullion.registry import query
from mullion.runtime import checkpoint_dir
from mullion.sources import catalog, sinks, spans


def scratch(t, name):
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return os.path.join(checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def n_rows(frames):
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("S1", """SELECT 'projects' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'documents', count(*) FROM orders UNION ALL SELECT 'doors', count(*) FROM lineitem
UNION ALL SELECT 'corrections', count(*) FROM events UNION ALL SELECT 'run_log', count(*) FROM events""")
def s1(t):
    at = scratch(t, "catalog")
    text = lambda df, *cols: df.select(*[F.col(c).cast("string").alias(c) if c not in ("created_at", "row_index") else F.col(c) for c in cols])
    sinks.write_table(text(t.L_projects, "id", "name", "code", "status"), at, "projects")
    sinks.write_table(text(t.L_docs, "id", "project_id", "filename", "status", "created_at"), at, "documents")
    sinks.write_table(text(t.L_doors, "document_id", "door_tag", "level", "door_width", "source"), at, "doors")
    sinks.write_table(t.L_corr.selectExpr("CAST(id AS STRING) AS id", "CAST(document_id AS STRING) AS document_id", "door_tag", "field", "now_value AS now", "created_at"), at, "corrections")
    sinks.write_table(t.L_runs.selectExpr("CAST(id AS STRING) AS id", "CAST(project_id AS STRING) AS project_id", "kind", "status", "CAST(cost_usd AS DECIMAL(10,4)) AS cost_usd", "created_at"), at, "run_log")
    return n_rows(catalog.load_catalog(t.spark, at, ["projects", "documents", "doors", "corrections", "run_log"]))


@query("S2", """SELECT manufacturer, kind, count(*) AS n, CAST(sum(list_price) AS DOUBLE) AS total FROM L_price GROUP BY 1, 2""")
def s2(t):
    at = scratch(t, "prices")
    sinks.write_table(t.L_price.select(F.col("manufacturer").alias("book_id"), "manufacturer", "model", "match_key", "kind", "finish", "size", "list_price", F.col("pdf_page").cast("int").alias("pdf_page")), at, "price_rows")
    rows = catalog._load(t.spark, at, ["price_rows"])["price_rows"]
    return rows.groupBy("manufacturer", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("list_price").cast("double").alias("total"))


@query("S3", """
WITH s AS (SELECT doc, page, x0 + CASE WHEN w % 2 = 1 THEN 0.1 ELSE 0.0 END AS x0, y0, x1, y1, trim(text) AS text, size, horizontal, line * 100000 + w AS pos FROM L_tok
  UNION ALL SELECT doc, page, x0 + 0.1, y0 + 0.1, x1, y1, text || ' ', size, horizontal, line * 100000 + w + 50000000 FROM L_tok WHERE w % 3 = 0)
SELECT doc, page, x0, y0, trim(text) AS text, size, horizontal FROM s QUALIFY row_number() OVER (PARTITION BY doc, page, round_even(x0 * 2, 0), round_even(y0 * 2, 0), trim(text) ORDER BY pos) = 1""")
def s3(t):
    cols = ["doc", "page", "x0", "y0", "x1", "y1", "text", "size", "horizontal", "pos"]
    a = t.L_tok.withColumn("pos", F.col("line") * 100000 + F.col("w")).withColumn("x0", F.col("x0") + F.when(F.col("w") % 2 == 1, 0.1).otherwise(0.0)).select(*cols)
    b = (t.L_tok.filter("w % 3 = 0").withColumn("pos", F.col("line") * 100000 + F.col("w") + 50000000).withColumn("x0", F.col("x0") + 0.1).withColumn("y0", F.col("y0") + 0.1)
         .withColumn("text", F.concat("text", F.lit(" "))).select(*cols))
    return spans.text_items(a.unionByName(b)).select("doc", "page", "x0", "y0", "text", "size", "horizontal")


@query("S4", """
SELECT doc, page, axis, pos, s AS start, CASE WHEN id % 5 = 0 THEN s + 1 ELSE e END AS "end" FROM L_seg WHERE id % 7 > 0 AND CASE WHEN id % 5 = 0 THEN 1 ELSE e - s END >= 2""")
def s4(t):
    end = F.when(F.col("id") % 5 == 0, F.col("s") + 1).otherwise(F.col("e"))
    slant = F.when(F.col("id") % 7 == 0, 5.0).otherwise(0.0)
    lie = F.col("axis") == "h"
    segs = t.L_seg.select("doc", "page", F.when(lie, F.col("s")).otherwise(F.col("pos")).alias("x0"), F.when(lie, F.col("pos")).otherwise(F.col("s")).alias("y0"),
                          F.when(lie, end).otherwise(F.col("pos") + slant).alias("x1"), F.when(lie, F.col("pos") + slant).otherwise(end).alias("y1"), (end - F.col("s")).alias("len"))
    return spans.rulings(segs.filter("len > 0.8")).select("doc", "page", "axis", "pos", "start", "end")


@query("S6", """SELECT id, manufacturer, match_key FROM L_price WHERE manufacturer = 'Brand#5' AND match_key IN (SELECT regexp_replace(upper(model), '[^A-Z0-9]', '', 'g') FROM L_items WHERE quantity > 48)""")
def s6(t):
    from mullion.functions import text
    keys = t.L_items.filter("quantity > 48").select(text.match_key(F.col("model")).alias("match_key")).distinct()
    return t.L_price.filter("manufacturer = 'Brand#5'").join(keys, "match_key", "left_semi").select("id", "manufacturer", "match_key")


@query("S7", """SELECT document_id, door_tag, level, row_index FROM L_doors WHERE level = 'F' OR suppkey % 2 = 0""")
def s7(t):
    at = scratch(t, "doors")
    cols = ["document_id", "door_tag", "level", "row_index"]
    sinks.write_table(t.L_doors.select(*cols), at, "doors", ["level"])
    path = sinks.write_table(t.L_doors.filter("level = 'O' AND suppkey % 2 = 0").select(*cols), at, "doors", ["level"])
    return t.spark.read.parquet(path).select(*cols)


@query("S8", """
SELECT d.id AS document_id, coalesce(n, 0) AS doors, coalesce(tags, '') AS tags FROM L_docs d LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(door_tag, ',' ORDER BY row_index, door_tag) AS tags FROM L_doors GROUP BY 1) x ON x.document_id = d.id
WHERE status = 'active'""")
def s8(t):
    sheets = t.L_doors.groupBy("document_id", F.col("level").alias("page")).agg(F.count(F.lit(1)).alias("doors_on"))
    det = t.L_doors.select("document_id", F.col("row_index").alias("id"), "source")
    out = sinks.export_project(t.L_docs, t.L_doors.select("document_id", "row_index", "door_tag", "level"), sheets, det)
    return out.select("document_id", F.coalesce(F.size("doors"), F.lit(0)).cast("bigint").alias("doors"), F.array_join(F.coalesce(F.col("doors.door_tag"), F.array().cast("array<string>")), ",").alias("tags")).withColumn(
        "doors", F.greatest("doors", F.lit(0)))


def rich_doors(t):
    return t.L_doors.selectExpr("document_id", "row_index", "door_tag", "IF(suppkey % 4 = 0, concat('2x', door_width), door_width) AS door_width", "door_material", "door_type",
                                "IF(suppkey % 3 = 0, concat('ROOM ', partkey % 9), '') AS from_space", "IF(suppkey % 6 = 0, 'EXTERIOR', '') AS to_space",
                                "IF(suppkey % 3 = 1, map('room', concat('R', partkey % 5), 'gauge', '16'), map('thk', '1 3/4')) AS extra")


@query("P19", """
SELECT document_id, row_index, door_tag AS "DOOR TAG", CASE WHEN suppkey % 4 = 0 THEN '2x' || door_width ELSE door_width END AS "WIDTH", CASE WHEN suppkey % 4 = 0 THEN '2' ELSE '' END AS "LEAF COUNT",
  CASE WHEN suppkey % 3 = 0 THEN 'ROOM ' || (partkey % 9) || CASE WHEN suppkey % 6 = 0 THEN ' to EXTERIOR' ELSE '' END WHEN suppkey % 3 = 1 THEN 'R' || (partkey % 5) ELSE '' END AS "DOOR LOCATION",
  CASE WHEN suppkey % 6 = 0 THEN 'EXTERIOR' ELSE '' END AS side, CASE WHEN suppkey % 3 = 1 THEN '16' ELSE '' END AS "FRAME GUAGE", CASE WHEN suppkey % 3 <> 1 THEN '1 3/4' ELSE '' END AS "THICKNESS", '1' AS "QUANTITY" FROM L_doors""")
def p19(t):
    m = sinks.master_sheet(rich_doors(t), ["document_id", "row_index"])
    return m.select("document_id", "row_index", "DOOR TAG", "WIDTH", "LEAF COUNT", "DOOR LOCATION", F.col("INTERIOR/EXTERIOR").alias("side"), "FRAME GUAGE", "THICKNESS", "QUANTITY")


@query("S9", f"""
SELECT c AS "column", c IN ('DOOR TAG', 'WIDTH', 'LEAF COUNT', 'DOOR LOCATION', 'INTERIOR/EXTERIOR', 'FRAME GUAGE', 'THICKNESS', 'QUANTITY', 'DOOR MATERIAL', 'DOOR ELEVATION TYPE') AND (SELECT count(*) > 0 FROM L_doors) AS filled
FROM (SELECT unnest([{', '.join("'" + c + "'" for c in sinks.MASTER_COLUMNS)}]) AS c)""")
def s9(t):
    return overlay.fields_filled(sinks.master_sheet(rich_doors(t)), sinks.MASTER_COLUMNS)


@query("S10", """
SELECT 'Per model' AS sheet, count(DISTINCT model) AS n FROM (SELECT model FROM L_calls UNION SELECT model FROM L_ans WHERE verified) UNION ALL SELECT 'Per call', count(*) FROM L_calls""")
def s10(t):
    from mullion.operators import prices as pr
    from mullion.plans.pricing import calls
    where = sinks.write_report({"Per model": pr.per_model(calls(t), t.L_ans), "Per call": calls(t).select("id", "step", "model", "usd", "outcome")}, scratch(t, "report"))
    return n_rows({k: t.spark.read.option("header", True).csv(v) for k, v in where.items()}).withColumnRenamed("tbl", "sheet")


@query("S11", """
WITH d AS (SELECT document_id, count(*) AS doors FROM L_doors GROUP BY 1), x AS (SELECT document_id, count(*) AS det FROM L_doors WHERE source = 'plan' AND partkey % 2 = 0 GROUP BY 1),
s AS (SELECT document_id, count(*) AS suppressed FROM L_corr WHERE now_value IS NULL GROUP BY 1), j AS (SELECT document_id, arg_max(status, id) AS plan_status FROM L_jobs WHERE kind = 'click' GROUP BY 1)
SELECT o.id AS document_id, coalesce(doors, 0) AS doors, coalesce(det, 0) AS detections, coalesce(suppressed, 0) AS suppressed, plan_status FROM L_docs o LEFT JOIN d ON d.document_id = o.id LEFT JOIN x ON x.document_id = o.id
LEFT JOIN s ON s.document_id = o.id LEFT JOIN j ON j.document_id = o.id""")
def s11(t):
    doors = overlay.doors_current(t.L_doors, t.L_corr).select("document_id", "row_index", "door_tag", "width", "edited")
    pages = t.L_doors.groupBy("document_id", F.col("level").alias("page")).agg(F.lit(False).alias("unreadable"))
    det = t.L_doors.filter("source = 'plan'").selectExpr("document_id", "row_index AS id", "door_tag", "partkey % 2 = 0 AS is_primary")
    jobs = t.L_jobs.withColumn("kind", F.when(F.col("kind") == "click", "plan").otherwise(F.col("kind")))
    out = sinks.stored_document(t.L_docs, doors, pages, det, t.L_corr.filter("now_value IS NULL"), jobs, primary_only=True)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return out.select("document_id", size("doors").alias("doors"), size("detections").alias("detections"), "suppressed", "plan_status")


@query("S12", """SELECT event_id, event_id % 4 <> 1 AND CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 60 AS accepted FROM events""")
def s12(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 4 == 1, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("row"))
    return replies.accept_rows(rows, "row", "k bigint", lambda p: p["k"].between(0, 60)).select("event_id", "accepted")
