"""Streaming queries: each drives the driver's events through a stream to its end."""

import os
import uuid

from pyspark.sql import functions as F

from mullion.registry import query
from mullion.runtime import checkpoint_dir
from mullion.streaming import feeds


def folder(t, name):
    return os.path.join(checkpoint_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def stream(t, table):
    """The table as a file stream, whether it is one file or a folder of them (a pattern may name either)."""
    static = getattr(t, table)
    return t.spark.readStream.schema(static.schema).parquet(os.path.join(t.dir, f"{table}.parque[t]"))


def job_stream(t):
    return stream(t, "events").selectExpr(
        "event_id AS id", "user_id AS document_id", "IF(event_type = 'click', 'plan', 'read') AS kind",
        "CASE WHEN event_id % 3 = 0 THEN 'ready' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'reading' END AS status", "ts AS updated_at")


_JOBS = """j AS (SELECT event_id AS id, user_id AS document_id, CASE WHEN event_type = 'click' THEN 'plan' ELSE 'read' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN 'ready' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'reading' END AS status, ts AS updated_at FROM events),
l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY document_id, kind ORDER BY updated_at DESC, id DESC) = 1)"""


@query("T2", f"WITH {_JOBS} SELECT document_id, kind, id, status FROM l")
def t2(t):
    table = feeds.LatestTable(t.spark, folder(t, "jobs"), ["document_id", "kind"], ["updated_at", "id"])
    return feeds.run_feed(job_stream(t), table, folder(t, "ck")).select("document_id", "kind", "id", "status")


@query("T1", f"""WITH {_JOBS}, n AS (SELECT max(updated_at) AS now FROM j)
SELECT document_id, kind, id, CASE WHEN status = 'reading' AND epoch(now) - epoch(updated_at) > CASE WHEN kind = 'plan' THEN 7200 ELSE 2700 END THEN 'failed' ELSE status END AS status,
  status = 'reading' AND epoch(now) - epoch(updated_at) > CASE WHEN kind = 'plan' THEN 7200 ELSE 2700 END AS stale FROM l, n""")
def t1(t):
    table = feeds.LatestTable(t.spark, folder(t, "jobs"), ["document_id", "kind"], ["updated_at", "id"])
    seen = feeds.run_feed(job_stream(t), table, folder(t, "ck"))
    now = t.events.agg(F.max("ts").alias("now")).select("now", F.lit(1).alias("_k"))  # event time, one row
    j = seen.withColumn("_k", F.lit(1)).join(F.broadcast(now), "_k")
    return feeds.as_seen(j, F.col("now")).select("document_id", "kind", "id", "status", "stale")


@query("T3", """
WITH p AS (SELECT user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'working' ELSE 'done' END AS status FROM events),
l AS (SELECT run_id, item_id, arg_max(status, event_id) AS status FROM p GROUP BY 1, 2)
SELECT run_id, count(*) AS items, count(*) FILTER (WHERE status = 'done') AS done FROM l GROUP BY 1""")
def t3(t):
    s = stream(t, "events").selectExpr("user_id AS run_id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS item_id", "event_id",
                                       "CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'working' ELSE 'done' END AS status")
    table = feeds.LatestTable(t.spark, folder(t, "items"), ["run_id", "item_id"], ["event_id"])
    return feeds.run_feed(s, table, folder(t, "ck")).groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("status") == "done", 1)).alias("done"))


@query("T4", """
SELECT DISTINCT ON (document_id, door_tag, field) document_id, door_tag, field, now_value, id FROM L_corr ORDER BY document_id, door_tag, field, created_at DESC, id DESC""")
def t4(t):
    raw = stream(t, "events")
    corr = type(t)(t.spark, t.dir)
    corr.__dict__["events"] = raw
    table = feeds.LatestTable(t.spark, folder(t, "corrections"), ["document_id", "door_tag", "field"], ["created_at", "id"])
    return feeds.run_feed(corr.L_corr, table, folder(t, "ck")).select("document_id", "door_tag", "field", "now_value", "id")


@query("T5", """
WITH w AS (SELECT user_id AS project_id, event_type AS app_version, time_bucket(INTERVAL 1 HOUR, ts) AS h, CAST(value AS DECIMAL(18,4)) AS usd FROM events),
m AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events)
SELECT project_id, app_version, CAST(h AS VARCHAR) AS hour, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS runs, h + INTERVAL 1 HOUR <= any_value(wm) AS closed
FROM w, m GROUP BY project_id, app_version, h""")
def t5(t):
    runs = stream(t, "events").selectExpr("event_id AS run_id", "user_id AS project_id", "event_type AS app_version", "CAST(ts AS TIMESTAMP) AS created_at",
                                          "CAST(value AS DECIMAL(18,4)) AS cost_usd")
    out = folder(t, "cost")
    feeds.cost_feed(runs, out, folder(t, "ck"))
    return feeds.cost_windows(t.spark, out).select("project_id", "app_version", F.col("window_start").cast("string").alias("hour"),
                                                   F.col("usd").cast("double").alias("usd"), "runs", "closed")


@query("T6", """
WITH d AS (SELECT source AS project_id, sha256(text) AS sha256, doc_id % 4 AS reader_version FROM documents)
SELECT project_id, sha256, max(reader_version) AS reader_version, max(reader_version) < 3 AS reread FROM d GROUP BY 1, 2""")
def t6(t):
    files = stream(t, "documents").selectExpr("source AS project_id", "sha2(text, 256) AS sha256", "doc_id % 4 AS reader_version",
                                              "timestamp_seconds(1700000000 + doc_id) AS created_at")
    out, ck = folder(t, "intake"), folder(t, "ck")
    taken = feeds.intake(files)
    (taken.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck)
     .trigger(availableNow=True).start().awaitTermination())
    return feeds.needs_reading(t.spark.read.schema(taken.schema).parquet(out), 3)
