"""Takeoff-shaped views of the driver tables.

Every lens exists twice: as a DataFrame on :class:`Tables` and as SQL in
``LENS_SQL``. All lenses are narrow projections (no shuffle), so an operator's
plan shows only the operator's own exchanges.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from mullion.sources.catalog import read_table

# Words the derived titles, numbers and headings are put together from.
STOREYS = ["LEVEL 1", "LEVEL 02", "FIRST FLOOR", "BASEMENT", "MEZZANINE", "COMPOSITE", "GROUND FLOOR", "EAST", "PHASE II", "MEZZ"]
SUBJECTS = ["FLOOR PLAN", "REFLECTED CEILING PLAN", "FLOOR & LIGHTING PLAN", "ROOF PLAN", "DOOR SCHEDULE", "SCHEDULES",
            "ENLARGED RESTROOM PLAN", "ENLARGED FLOOR PLAN PART A", "EXIT PLAN", "FURNITURE PLAN", "SITE PLAN", "UNIT PLANS",
            "STAIR PLAN", "WALL SECTION", "KEY PLAN", "SPECIALIZED PLANNING", "FLOOR PLAN AND REFLECTED CEILING PLAN",
            "WINDOW SCHEDULE", "DOOR & FRAME TYPES", "DETAILS"]
PREFIXES = ["A", "AV", "CR", "S", "I", "M", "AD", "IA", "E", ""]
HEADINGS = ["DOOR NO.", "WIDTH", "HEIGHT", "TYPE", "MATERIAL", "MATERIAL", "FINISH", "FRAME FINISH", "HARDWARE SET", "REMARKS",
            "FROM ROOM", "TO ROOM", "FIRE RATING", "THRESHOLD", "REBAR", "NECK SIZE", "UNIT COST", "LOUVER", "FRAME TYPE", "DOOR THK"]


def pick(words: list[str], at: str, engine: str) -> str:
    """SQL text choosing a word by an index expression."""
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    if engine == "spark":
        return f"element_at(array({quoted}), CAST({at} AS INT) + 1)"
    return f"[{quoted}][CAST({at} AS INT) + 1]"


def _titles(engine: str) -> list[str]:
    one = pick(PREFIXES, "o_custkey % 10", engine)
    return [
        "o_orderkey AS id", "o_orderpriority AS doc", "o_custkey AS page",
        f"concat({one}, CAST(o_orderkey % 9 + 1 AS {'STRING' if engine == 'spark' else 'VARCHAR'}), '.', "
        f"CAST(o_orderkey % 20 AS {'STRING' if engine == 'spark' else 'VARCHAR'})) AS number",
        f"concat({pick(STOREYS, 'o_orderkey % 10', engine)}, ' ', {pick(SUBJECTS, 'o_custkey * 7 % 20', engine)}) AS title",
    ]


def _sizes(engine: str) -> list[str]:
    return [
        "l_orderkey AS k1", "l_partkey AS k2", "l_suppkey AS k3", "l_linenumber AS k4",
        "CAST(l_quantity AS BIGINT) AS a", "l_partkey % 12 AS b", "l_suppkey % 4 AS c",
    ]


LENS_SQL: dict[str, str] = {
    "L_title": f"SELECT {', '.join(_titles('duckdb'))} FROM orders",
    "L_size": f"SELECT {', '.join(_sizes('duckdb'))} FROM lineitem",
    # One span per word: 40 pt columns, 12 pt lines.
    "L_tok": """
        SELECT source AS doc, doc_id AS page, line, w, word AS text,
               CAST(40.0 * w AS DOUBLE) AS x0, CAST(12.0 * line AS DOUBLE) AS y0,
               CAST(40.0 * w + 6.0 * length(word) AS DOUBLE) AS x1,
               CAST(12.0 * line + 10.0 AS DOUBLE) AS y1,
               CAST(8 + length(word) % 3 AS DOUBLE) AS size, length(word) % 17 <> 0 AS horizontal
        FROM (SELECT source, doc_id, line, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS w
              FROM (SELECT source, doc_id, line, string_split(ltext, ' ') AS words
                    FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS ltext,
                                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
                          FROM documents)))
        WHERE word <> ''""",
    # The same page as a drawing: every third word is a three-digit mark.
    "L_plan": """
        SELECT doc, page, line, w, x0, y0, x1, y1, size, horizontal,
               CASE WHEN w % 3 = 0 THEN CAST(100 + (w * 7 + line * 13 + length(text)) % 60 AS VARCHAR)
                    ELSE upper(replace(text, 'ß', 'ss')) END AS text
        FROM L_tok""",
    "L_seg": """
        SELECT o_orderpriority AS doc, CAST(o_custkey % 100 AS BIGINT) AS page, o_orderkey AS id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE 'h' END AS axis,
               CAST(o_custkey % 200 * 5 AS DOUBLE) AS pos,
               CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS s,
               CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS DOUBLE) AS e
        FROM orders""",
    "L_projects": """
        SELECT c_custkey AS id, c_name AS name, c_mktsegment AS code,
               CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS status
        FROM customer""",
    "L_docs": """
        SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS filename,
               CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM orders""",
    "L_doors": """
        SELECT l_orderkey AS document_id, CAST(l_linenumber AS VARCHAR) AS door_tag,
               l_linestatus AS level, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS door_width,
               CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS door_height,
               l_returnflag AS door_type,
               CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE CAST(l_suppkey % 9 AS VARCHAR) END AS door_material,
               CASE WHEN l_suppkey % 5 = 0 THEN 'plan' ELSE 'schedule' END AS source,
               CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 100000 + l_suppkey AS row_index,
               l_partkey AS partkey, l_suppkey AS suppkey
        FROM lineitem""",
    "L_corr": """
        SELECT event_id AS id, user_id AS document_id,
               CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 + 1 AS VARCHAR) AS door_tag,
               CASE event_type WHEN 'click' THEN 'door_width' WHEN 'view' THEN 'door_height'
                    WHEN 'error' THEN 'door_type' WHEN 'purchase' THEN 'door_material' ELSE event_type END AS field,
               CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS now_value,
               ts AS created_at
        FROM events""",
    "L_runs": """
        SELECT event_id AS id, user_id AS project_id, user_id * 7 AS document_id, event_type AS kind,
               CASE WHEN event_id % 6 = 0 THEN 'failed' ELSE 'ok' END AS status,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS doors_scheduled,
               CAST(json_extract_string(props, '$.k') AS BIGINT) * (event_id % 5) // 4 AS doors_located,
               CAST(CAST(value AS DECIMAL(18,4)) / 100 AS DECIMAL(18,6)) AS cost_usd, ts AS created_at
        FROM events""",
    "L_calls": """
        SELECT event_id AS id, user_id AS project_id, event_type AS model,
               'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS manufacturer,
               CASE event_id % 4 WHEN 0 THEN 'A' WHEN 3 THEN 'identify' ELSE 'B' END AS step,
               'K' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS key1,
               'K' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) AS key2,
               CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 AS prompt_tokens,
               CAST(event_id % 900 AS BIGINT) AS completion_tokens,
               CAST(CAST(value AS DECIMAL(18,4)) / 1000 AS DECIMAL(18,6)) AS usd,
               CASE WHEN event_id % 11 = 0 THEN 'cut_off' ELSE 'ok' END AS outcome, ts AS created_at
        FROM events""",
    "L_price": """
        SELECT p_partkey AS id, p_brand AS manufacturer, p_name || '-' || CAST(p_size AS VARCHAR) AS model,
               regexp_replace(upper(p_name || '-' || CAST(p_size AS VARCHAR)), '[^A-Z0-9]', '', 'g') AS match_key,
               CASE WHEN p_partkey % 7 = 3 THEN 'size_add' WHEN p_partkey % 7 = 5 THEN 'option_add' ELSE 'base' END AS kind,
               p_type AS finish, CAST(p_size AS VARCHAR) AS size,
               CAST(p_retailprice AS DECIMAL(12,2)) AS list_price, p_partkey % 50 + 1 AS pdf_page
        FROM part""",
    "L_items": """
        SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS id, l_orderkey AS project_id,
               p_brand AS manufacturer, p_name || '-' || CAST(p_size AS VARCHAR) AS model, p_type AS finish,
               CAST(p_size AS VARCHAR) AS size, p_name AS name, CAST(l_quantity AS BIGINT) AS quantity,
               l_partkey AS partkey, l_suppkey AS suppkey
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "L_box": """
        SELECT vec_id AS id, CAST(label AS BIGINT) AS page, vec_id % 2 = 0 AS is_door,
               1000.0 * CAST(embedding[1] AS DOUBLE) AS cx, 1000.0 * CAST(embedding[2] AS DOUBLE) AS cy,
               1000.0 * CAST(embedding[1] AS DOUBLE) - 5.0 AS x0, 1000.0 * CAST(embedding[2] AS DOUBLE) - 5.0 AS y0,
               1000.0 * CAST(embedding[1] AS DOUBLE) + 5.0 AS x1, 1000.0 * CAST(embedding[2] AS DOUBLE) + 5.0 AS y1,
               'T' || CAST(vec_id % 97 AS VARCHAR) AS tag,
               20.0 + CAST(floor(abs(CAST(embedding[3] AS DOUBLE)) * 100.0) AS DOUBLE) AS radius,
               CAST(abs(embedding[4]) AS DOUBLE) AS residual,
               CASE vec_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
        FROM embeddings""",
    "L_cut": """
        SELECT vec_id AS id, CAST(label AS BIGINT) AS page,
               1000.0 * CAST(embedding[1] AS DOUBLE) AS x0, 1000.0 * CAST(embedding[2] AS DOUBLE) AS y0,
               1000.0 * CAST(embedding[1] AS DOUBLE) + 200.0 * CAST(embedding[5] AS DOUBLE) AS x1,
               1000.0 * CAST(embedding[2] AS DOUBLE) + 200.0 * CAST(embedding[6] AS DOUBLE) AS y1
        FROM embeddings""",
    "L_book": """
        SELECT host AS book, page_id AS page, line, trim(ltext) AS text
        FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id,
                     unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS ltext,
                     generate_subscripts(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), 1) - 1 AS line
              FROM pages)
        WHERE trim(ltext) <> ''""",
    "L_jobs": """
        SELECT event_id AS id, user_id AS document_id, event_type AS kind,
               CASE WHEN event_id % 3 = 0 THEN 'ready' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'reading' END AS status,
               ts AS updated_at
        FROM events""",
    "L_ans": """
        SELECT doc_id, 'quality' AS model, quality AS total, quality AS truth, toxic = 0 AS verified FROM labels
        UNION ALL
        SELECT doc_id, 'toxic' AS model, toxic AS total, quality AS truth, toxic = 0 AS verified FROM labels""",
    "L_line": """
        SELECT source AS doc, doc_id AS page, line, ltext AS text
        FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS ltext,
                     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
              FROM documents)""",
}


TEXT_TABLES = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Raw texts over all cores when the input has fewer splits than that.

    Exploding text multiplies it, so a small file read by one task would leave the
    rest idle; an input with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The driver tables of one folder and the lenses over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = read_table(self.spark, self.dir, name)
        return spread(df) if name in TEXT_TABLES else df

    @cached_property
    def L_title(self) -> DataFrame:
        return self.orders.selectExpr(*_titles("spark"))

    @cached_property
    def L_size(self) -> DataFrame:
        return self.lineitem.selectExpr(*_sizes("spark"))

    @cached_property
    def L_line(self) -> DataFrame:
        return self.documents.select(
            F.col("source").alias("doc"), F.col("doc_id").alias("page"),
            F.posexplode(F.split("text", "\n")).alias("line", "text"))

    @cached_property
    def L_tok(self) -> DataFrame:
        return (self.L_line
                .select("doc", "page", "line", F.posexplode(F.split("text", " ")).alias("w", "word"))
                .filter("word <> ''")
                .selectExpr("doc", "page", "line", "w", "word AS text",
                            "40.0D * w AS x0", "12.0D * line AS y0",
                            "40.0D * w + 6.0D * length(word) AS x1", "12.0D * line + 10.0D AS y1",
                            "CAST(8 + length(word) % 3 AS DOUBLE) AS size",
                            "length(word) % 17 <> 0 AS horizontal"))

    @cached_property
    def L_plan(self) -> DataFrame:
        return self.L_tok.selectExpr(
            "doc", "page", "line", "w", "x0", "y0", "x1", "y1", "size", "horizontal",
            "CASE WHEN w % 3 = 0 THEN CAST(100 + (w * 7 + line * 13 + length(text)) % 60 AS STRING) "
            "ELSE upper(replace(text, 'ß', 'ss')) END AS text")

    @cached_property
    def L_seg(self) -> DataFrame:
        day = "datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01')"
        return self.orders.selectExpr(
            "o_orderpriority AS doc", "CAST(o_custkey % 100 AS BIGINT) AS page", "o_orderkey AS id",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE 'h' END AS axis",
            "CAST(o_custkey % 200 * 5 AS DOUBLE) AS pos",
            f"CAST({day} AS DOUBLE) AS s", f"CAST({day} + 1 + o_orderkey % 30 AS DOUBLE) AS e")

    @cached_property
    def L_projects(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey AS id", "c_name AS name", "c_mktsegment AS code",
            "CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS status")

    @cached_property
    def L_docs(self) -> DataFrame:
        return self.orders.selectExpr(
            "o_orderkey AS id", "o_custkey AS project_id", "o_orderpriority AS filename",
            "CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status",
            "CAST(o_orderdate AS TIMESTAMP) AS created_at")

    @cached_property
    def L_doors(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "l_orderkey AS document_id", "CAST(l_linenumber AS STRING) AS door_tag", "l_linestatus AS level",
            "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS door_width",
            "CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING) AS door_height", "l_returnflag AS door_type",
            "CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE CAST(l_suppkey % 9 AS STRING) END AS door_material",
            "CASE WHEN l_suppkey % 5 = 0 THEN 'plan' ELSE 'schedule' END AS source",
            "CAST(l_linenumber AS BIGINT) * 10000000000L + l_partkey * 100000 + l_suppkey AS row_index",
            "l_partkey AS partkey", "l_suppkey AS suppkey")

    @cached_property
    def L_corr(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id AS id", "user_id AS document_id",
            "CAST(CAST(get_json_object(props, '$.k') AS BIGINT) % 7 + 1 AS STRING) AS door_tag",
            "CASE event_type WHEN 'click' THEN 'door_width' WHEN 'view' THEN 'door_height' "
            "WHEN 'error' THEN 'door_type' WHEN 'purchase' THEN 'door_material' ELSE event_type END AS field",
            "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS now_value",
            "ts AS created_at")

    @cached_property
    def L_runs(self) -> DataFrame:
        k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
        return self.events.selectExpr(
            "event_id AS id", "user_id AS project_id", "user_id * 7 AS document_id", "event_type AS kind",
            "CASE WHEN event_id % 6 = 0 THEN 'failed' ELSE 'ok' END AS status",
            f"{k} AS doors_scheduled", f"{k} * (event_id % 5) DIV 4 AS doors_located",
            "CAST(CAST(value AS DECIMAL(18,4)) / 100 AS DECIMAL(18,6)) AS cost_usd", "ts AS created_at")

    @cached_property
    def L_calls(self) -> DataFrame:
        k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
        return self.events.selectExpr(
            "event_id AS id", "user_id AS project_id", "event_type AS model",
            "concat('Brand#', CAST(user_id % 25 + 1 AS STRING)) AS manufacturer",
            "CASE event_id % 4 WHEN 0 THEN 'A' WHEN 3 THEN 'identify' ELSE 'B' END AS step",
            f"concat('K', {k}) AS key1", f"concat('K', {k} + 1) AS key2",
            f"{k} * 37 AS prompt_tokens", "CAST(event_id % 900 AS BIGINT) AS completion_tokens",
            "CAST(CAST(value AS DECIMAL(18,4)) / 1000 AS DECIMAL(18,6)) AS usd",
            "CASE WHEN event_id % 11 = 0 THEN 'cut_off' ELSE 'ok' END AS outcome", "ts AS created_at")

    @cached_property
    def L_price(self) -> DataFrame:
        model = "concat(p_name, '-', CAST(p_size AS STRING))"
        return self.part.selectExpr(
            "p_partkey AS id", "p_brand AS manufacturer", f"{model} AS model",
            f"regexp_replace(upper({model}), '[^A-Z0-9]', '') AS match_key",
            "CASE WHEN p_partkey % 7 = 3 THEN 'size_add' WHEN p_partkey % 7 = 5 THEN 'option_add' ELSE 'base' END AS kind",
            "p_type AS finish", "CAST(p_size AS STRING) AS size",
            "CAST(p_retailprice AS DECIMAL(12,2)) AS list_price", "p_partkey % 50 + 1 AS pdf_page")

    @cached_property
    def L_items(self) -> DataFrame:
        return (self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
                .join(self.part, F.col("l_partkey") == F.col("p_partkey"))
                .selectExpr(
                    "l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS id",
                    "l_orderkey AS project_id", "p_brand AS manufacturer",
                    "concat(p_name, '-', CAST(p_size AS STRING)) AS model", "p_type AS finish",
                    "CAST(p_size AS STRING) AS size", "p_name AS name",
                    "CAST(l_quantity AS BIGINT) AS quantity", "l_partkey AS partkey", "l_suppkey AS suppkey"))

    @cached_property
    def L_box(self) -> DataFrame:
        return (self.embeddings
                .selectExpr("vec_id AS id", "CAST(label AS BIGINT) AS page", "vec_id % 2 = 0 AS is_door",
                            "1000.0D * CAST(embedding[0] AS DOUBLE) AS cx",
                            "1000.0D * CAST(embedding[1] AS DOUBLE) AS cy",
                            "concat('T', CAST(vec_id % 97 AS STRING)) AS tag",
                            "20.0D + floor(abs(CAST(embedding[2] AS DOUBLE)) * 100.0D) AS radius",
                            "CAST(abs(embedding[3]) AS DOUBLE) AS residual",
                            "CASE vec_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence")
                .selectExpr("*", "cx - 5.0D AS x0", "cy - 5.0D AS y0", "cx + 5.0D AS x1", "cy + 5.0D AS y1"))

    @cached_property
    def L_cut(self) -> DataFrame:
        return self.embeddings.selectExpr(
            "vec_id AS id", "CAST(label AS BIGINT) AS page",
            "1000.0D * CAST(embedding[0] AS DOUBLE) AS x0", "1000.0D * CAST(embedding[1] AS DOUBLE) AS y0",
            "1000.0D * CAST(embedding[0] AS DOUBLE) + 200.0D * CAST(embedding[4] AS DOUBLE) AS x1",
            "1000.0D * CAST(embedding[1] AS DOUBLE) + 200.0D * CAST(embedding[5] AS DOUBLE) AS y1")

    @cached_property
    def L_book(self) -> DataFrame:
        return (self.pages
                .select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("book"),
                        F.col("page_id").alias("page"),
                        F.posexplode(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n")).alias("line", "text"))
                .withColumn("text", F.trim("text")).filter("text <> ''"))

    @cached_property
    def L_jobs(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id AS id", "user_id AS document_id", "event_type AS kind",
            "CASE WHEN event_id % 3 = 0 THEN 'ready' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'reading' END AS status",
            "ts AS updated_at")

    @cached_property
    def L_ans(self) -> DataFrame:
        return self.labels.selectExpr(
            "doc_id", "stack(2, 'quality', quality, 'toxic', toxic) AS (model, total)",
            "quality AS truth", "toxic = 0 AS verified")
