"""Sheet, title and table queries."""

from pyspark.sql import functions as F

from mullion.functions import text, vocab
from mullion.lenses import HEADINGS, pick
from mullion.operators import sheets as sh, tables as tb
from mullion.plans.scalars import _HEADS, _NORM, _TAG_SQL, header_rows, q
from mullion.registry import query

_CELLS = "(SELECT doc, page, line, string_split(text, ' ') AS cells FROM L_line)"


def cell_rows(t):
    return t.L_line.select("doc", "page", "line", F.split("text", " ").alias("cells"))


@query("P7", rf"""
SELECT doc, page, line, len(f) = 0 OR len(f) = 1 AND cells[1] <> '' AND length(cells[1]) <= 2 OR len(list_filter(f, lambda c: length(c) > 1 OR regexp_matches(c, '[\p{{L}}\p{{N}}]'))) = 0 AS noise
FROM (SELECT *, list_filter(cells, lambda c: c <> '') AS f FROM {_CELLS})""")
def p7(t):
    return cell_rows(t).select("doc", "page", "line", tb.is_noise(F.col("cells")).alias("noise"))


@query("P8", rf"""
SELECT doc, page, line, len(f) = 1 AND NOT {_TAG_SQL.format(c='coalesce(f[1], chr(32))')} AS band FROM (SELECT *, list_filter(cells, lambda c: trim(c) <> '') AS f FROM {_CELLS})""")
def p8(t):
    return cell_rows(t).select("doc", "page", "line", tb.is_band(F.col("cells")).alias("band"))


@query("P9", f"""
WITH n AS (SELECT *, {_NORM.format(u='upper(tag)')} AS norm FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Door No.' WHEN 2 THEN substr(p_name, 1, 2) ELSE p_name || p_size END AS tag FROM part))
SELECT p_partkey, norm <> '' AND (norm IN ({q(vocab.HEADING_TAGS)}) OR NOT regexp_matches(norm, '[0-9]') AND length(norm) >= 3) AS heading FROM n""")
def p9(t):
    s = t.part.selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Door No.' WHEN 2 THEN substr(p_name, 1, 2) ELSE concat(p_name, p_size) END AS tag")
    return s.select("p_partkey", tb.is_heading_row(F.col("tag")).alias("heading"))


_NU = _NORM.format(u="upper(replace(c, 'ß', 'ss'))")


@query("P10", f"""
WITH c AS (SELECT doc, page, line, list_distinct(list_transform(list_filter(cells, lambda c: c <> ''), lambda c: {_NU})) AS r FROM {_CELLS}), h AS (SELECT doc, page, r AS h FROM c WHERE line = 0)
SELECT doc, page, line, len(r) > 0 AND len(h) > 0 AND len(list_intersect(r, h)) >= greatest(2, len(r) // 2) AS header FROM c JOIN h USING (doc, page)""")
def p10(t):
    rows = cell_rows(t).withColumn("cells", F.transform("cells", lambda c: F.replace(c, F.lit("ß"), F.lit("ss"))))
    head = rows.filter("line = 0").select("doc", "page", F.col("cells").alias("headers"))
    return rows.join(head, ["doc", "page"]).select("doc", "page", "line", tb.looks_like_header(F.col("cells"), F.col("headers")).alias("header"))


@query("P4", """
SELECT book, page, line FROM L_book WHERE len(list_intersect(string_split(lower(text), ' '), ['home', 'about', 'the', 'le', 'contact'])) > 0""")
def p4(t):
    keys = F.array(*[F.lit(w) for w in ("home", "about", "the", "le", "contact")])
    return t.L_book.filter(F.arrays_overlap(F.split(F.lower("text"), " "), keys)).select("book", "page", "line")


_LONG = "SELECT document_id, level, row_index, unnest(['door_tag', 'door_width', 'door_material', 'door_type']) AS field, unnest([0, 1, 2, 3]) AS col, unnest([door_tag, CASE WHEN level = 'F' THEN door_width || ' mm' ELSE door_width END, door_material, door_type]) AS value FROM L_doors"


def long_cells(t):
    w = F.when(F.col("level") == "F", F.concat("door_width", F.lit(" mm"))).otherwise(F.col("door_width"))
    d = t.L_doors.withColumn("door_width", w)
    return d.select("document_id", "level", F.col("row_index").alias("row"), F.posexplode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("door_tag", "door_width", "door_material", "door_type")])).alias("col", "c")).select(
        "document_id", "level", "row", "col", "c.*")


@query("P18", f"""
WITH l AS ({_LONG}) SELECT document_id, col FROM l WHERE field <> 'door_tag' AND trim(value) <> '' GROUP BY 1, 2
HAVING count(*) FILTER (WHERE regexp_matches(value, '^[0-9]+ mm$')) * 2 > count(*)""")
def p18(t):
    return tb.metric_columns(long_cells(t), ["document_id"])


@query("P25", """
WITH l AS (SELECT doc, page, line, count(*) AS cells, count(*) FILTER (WHERE (w + line) % 5 < 3) AS numeric FROM L_tok GROUP BY ALL),
m AS (SELECT doc, page, greatest(coalesce(max(CASE WHEN NOT (cells >= 3 AND numeric >= cells * 0.6) THEN line END), min(line)), min(line)) AS last FROM l GROUP BY ALL)
SELECT doc, page, line FROM l JOIN m USING (doc, page) WHERE line <= last""")
def p25(t):
    lines = t.L_tok.groupBy("doc", "page", "line").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when((F.col("w") + F.col("line")) % 5 < 3, 1)).alias("numeric"))
    return tb.drop_data_lines(lines, ["doc", "page"]).select("doc", "page", "line")


_GROUPS = ["DOOR", "DOORS", "FRAME", "FRAMES", "OPENING", "OPENINGS", "LEAF", "LEAVES", "PANEL", "PANELS", "DETAILS", "DIMENSION", "DIMENSIONS", "AND", "OF", "TOTAL"]
_CAPS = f"concat({pick(HEADINGS, 'id % 20', '{e}')}, ' ', {pick(HEADINGS, 'page % 20', '{e}')}, CASE WHEN id % 7 = 0 THEN ' LEVEL 2' ELSE '' END)"
_KNOWN = [w for w in vocab.HEADER_WORDS if " " not in w and "." not in w] + list(vocab.ABBREVIATIONS)


def caps(engine):
    return f"concat({pick(HEADINGS, 'id % 20', engine)}, ' ', {pick(HEADINGS, 'page % 20', engine)}, CASE WHEN id % 7 = 0 THEN ' LEVEL 2' ELSE '' END)"


@query("P26", f"""
WITH c AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'NOTE: ' || t ELSE t END AS t FROM (SELECT id, {caps('duckdb')} AS t FROM L_title)),
w AS (SELECT *, list_filter(regexp_split_to_array(upper(t), '[^A-Z0-9.#_]+'), lambda x: x <> '') AS ws FROM c)
SELECT id, length(t) BETWEEN 1 AND 80 AND NOT starts_with(t, 'NOTE') AND NOT (len(ws) >= 2 AND len(list_filter(ws, lambda x: x NOT IN ({q(_GROUPS + _KNOWN)}) AND rtrim(x, '.') NOT IN ({q(_KNOWN)}) OR x IN ('NO.'))) = 0) AS caption FROM w""")
def p26(t):
    c = t.L_title.selectExpr("id", f"{caps('spark')} AS t").withColumn("t", F.when(F.col("id") % 11 == 0, F.concat(F.lit("NOTE: "), "t")).otherwise(F.col("t")))
    return c.select("id", tb.is_caption(F.col("t")).alias("caption"))


_EV = f"""e AS (SELECT document_id, level, count(*) AS rows, count(nullif(door_material, '')) AS tagged, count(DISTINCT nullif(door_material, '')) AS d,
  count(*) FILTER (WHERE {_TAG_SQL.format(c='door_material')}) AS shaped FROM L_doors GROUP BY 1, 2),
n AS (SELECT *, tagged >= 2 AND d * 2 >= tagged AND shaped * 2 >= tagged AS names_doors FROM e)"""


def evidence(t):
    return tb.tag_evidence(t.L_doors.select("document_id", "level", F.col("door_material").alias("door_tag")), ["document_id", "level"])


@query("P27", f"WITH {_EV} SELECT document_id, level, names_doors FROM n")
def p27(t):
    return evidence(t).select("document_id", "level", "names_doors")


@query("P28", f"""WITH {_EV} SELECT document_id, level, rows >= 2 AND (document_id % 6 >= 4 OR document_id % 6 = 3 AND level = 'F' AND names_doors AND document_id % 4 > 0) AS accepted FROM n""")
def p28(t):
    e = evidence(t).withColumns({"fields": F.col("document_id") % 6, "has_tag": F.col("level") == "F", "foreign": F.col("document_id") % 4 == 0})
    return tb.looks_like_schedule(e).select("document_id", "level", "accepted")


@query("P29", """
WITH n AS (SELECT page, count(*) AS n FROM L_tok WHERE length(text) > 6 GROUP BY page)
SELECT doc_id AS page, coalesce(n, 0) AS n, coalesce(n, 0) < 60 AS unreadable, coalesce(n, 0) < 60 AND doc_id % 2 = 0 AS image_only FROM documents LEFT JOIN n ON n.page = doc_id""")
def p29(t):
    pages = t.documents.select(F.col("doc_id").alias("page"), (F.col("doc_id") % 2 == 0).alias("has_raster"))
    return sh.page_flags(t.L_tok.filter("length(text) > 6"), pages, ["page"]).select("page", "n", "unreadable", "image_only")


@query("A19", f"""
WITH h AS (SELECT id, unnest([{_HEADS}]) AS heading FROM L_title), k AS (SELECT id, upper(heading) AS u, unnest(regexp_extract_all(upper(heading), '[A-Z0-9._]+')) AS w FROM h WHERE length(heading) <= 32),
ab AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in vocab.ABBREVIATIONS.items())}) v(a, b)),
x AS (SELECT id, w AS word FROM k WHERE w IN ({q([w for w in vocab.HEADER_WORDS if ' ' not in w and '.' not in w])}) UNION SELECT id, b FROM k JOIN ab ON a = w
  UNION SELECT id, p FROM k, (SELECT unnest(['DOOR NO', 'F.R', 'CARD READER']) AS p) WHERE contains(u, p))
SELECT id, string_agg(word, ',' ORDER BY word) AS words FROM x GROUP BY id""")
def a19(t):
    cells = header_rows(t).select("id", F.explode("headers").alias("h"))
    return cells.select("id", F.explode(text.header_words(F.col("h"))).alias("word")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"))


@query("A20", f"""WITH l AS ({_LONG}), w AS (SELECT document_id, col, CASE WHEN row_index % 3 > 0 THEN value ELSE '' END AS value FROM l UNION ALL SELECT document_id, 4, '' FROM l WHERE document_id % 2 = 0 AND col = 0)
SELECT document_id, count(*) FILTER (WHERE value <> '') < count(*) * 0.3 OR count(DISTINCT col) < 5 AS thin FROM w GROUP BY 1""")
def a20(t):
    cells = long_cells(t).select("document_id", "col", F.when(F.col("row") % 3 > 0, F.col("value")).otherwise("").alias("value"))
    # Every other document has a fifth column, with nothing in it.
    fifth = cells.filter("document_id % 2 = 0 AND col = 0").select("document_id", F.lit(4).alias("col"), F.lit("").alias("value"))
    return tb.is_thin(cells.unionByName(fifth), ["document_id"]).select("document_id", "thin")


@query("A35", f"""WITH l AS ({_LONG}), f AS (SELECT document_id, col, value, min(row_index) AS r FROM l WHERE value <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY document_id, col ORDER BY r, value) AS rn FROM f)
SELECT document_id, col, string_agg(value, ',' ORDER BY rn) AS samples FROM k WHERE rn <= 3 GROUP BY 1, 2""")
def a35(t):
    return tb.column_samples(long_cells(t).select("document_id", "col", "row", "value"), ["document_id", "col"]).select("document_id", "col", F.array_join("samples", ",").alias("samples"))


@query("F5", f"""WITH l AS ({_LONG}), n AS (SELECT document_id, col, count(*) AS rows, count(nullif(value, '')) AS f, count(DISTINCT nullif(value, '')) AS k, max(length(value)) AS mx FROM l GROUP BY 1, 2)
SELECT document_id, col FROM n WHERE f >= 3 AND f >= rows * 0.6 AND mx <= 10 AND k >= f * 0.9 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY CAST(k AS DOUBLE) / f DESC, col) = 1""")
def f5(t):
    return tb.infer_tag_column(long_cells(t), ["document_id"])


@query("F6", """
WITH c AS (SELECT id, page, unnest(range(6)) AS col FROM L_title),
d AS (SELECT id, col, ['hw_set', 'door_width', '', 'door_height', '', 'door_type'][col + 1] AS field, ['HARDWARE', 'SIDELITE WIDTH', 'PANEL WIDTH', 'HEIGHT', 'SIZE', 'TYPE'][col + 1] AS header,
  (id + col * 3) % 11 AS filled, CASE WHEN col = 0 THEN CASE WHEN page % 2 = 0 THEN (id + col * 3) % 11 ELSE 0 END ELSE 0 END AS marks, CASE WHEN col = 4 THEN (id + col * 3) % 11 - page % 2 ELSE 0 END AS pairs FROM c),
e AS (SELECT *, CASE WHEN col IN (0, 5) AND filled > 0 AND marks = filled THEN '' ELSE field END AS f1 FROM d),
w AS (SELECT id, max(CASE WHEN col = 1 THEN filled END) AS w1, max(CASE WHEN col = 2 THEN filled END) AS w2, max(CASE WHEN col = 3 THEN filled END) AS h, max(CASE WHEN col = 4 THEN filled END) AS sz,
  max(CASE WHEN col = 4 THEN pairs END) AS pr, max(CASE WHEN col = 0 THEN f1 END) AS hw, max(CASE WHEN col = 5 THEN f1 END) AS ty FROM e GROUP BY id),
x AS (SELECT *, CASE WHEN w1 * 2 >= 10 THEN 1 WHEN w2 * 2 >= 10 THEN 2 ELSE 0 END AS wc, h * 2 >= 10 AS hc FROM w)
SELECT id, hw || '|' || CASE WHEN wc = 1 THEN 'door_width' ELSE '' END || '|' || CASE WHEN wc = 2 THEN 'door_width' ELSE '' END || '|' || CASE WHEN hc THEN 'door_height' ELSE '' END || '||' || ty AS fields,
  CASE WHEN (wc = 0 OR NOT hc) AND sz > 0 AND sz * 2 >= 10 AND pr * 2 > sz THEN CAST(4 AS BIGINT) END AS size_col FROM x""")
def f6(t):
    f = pick(["hw_set", "door_width", "", "door_height", "", "door_type"], "col", "spark")
    h = pick(["HARDWARE", "SIDELITE WIDTH", "PANEL WIDTH", "HEIGHT", "SIZE", "TYPE"], "col", "spark")
    c = t.L_title.selectExpr("id", "page", "explode(sequence(0, 5)) AS col").selectExpr("id", "page", "col", f"{f} AS field", f"{h} AS header", "10 AS rows", "(id + col * 3) % 11 AS filled")
    c = c.selectExpr("id", "col", "field", "header", "rows", "filled", "IF(col = 0 AND page % 2 = 0, filled, 0) AS marks", "IF(col = 4, filled - page % 2, 0) AS pairs")
    return tb.settle_fields(c, ["id"]).select("id", F.array_join("fields", "|").alias("fields"), F.col("size_col").cast("bigint").alias("size_col"))


def level_titles(engine):
    names = ["LEVEL 1", "LEVEL 2", "GARAGE", "UNITS", "CONTINUED"]
    return f"concat('DOOR SCHEDULE', CASE WHEN page % 3 = 0 THEN '' ELSE concat(CASE WHEN page % 2 = 0 THEN '_' ELSE ' - ' END, {pick(names, 'id % 5', engine)}) END)"


@query("F20", f"""
WITH t AS (SELECT page AS doc, id, {level_titles('duckdb')} AS t FROM L_title),
g AS (SELECT doc, count(DISTINCT t) AS d, min(length(t)) AS mn, min(t) AS a, max(t) AS b, list(DISTINCT t) AS ts FROM t GROUP BY doc),
s AS (SELECT *, len(list_filter(range(1, mn + 1), lambda i: a[1:i] = b[1:i])) AS shared FROM g WHERE d >= 2),
k AS (SELECT *, list_max(list_concat([0], list_filter(range(1, shared + 1), lambda i: a[i] IN (' ', '_', '-', ':') AND len(list_filter(ts, lambda x: regexp_matches(x[i + 1:], '[A-Za-z]'))) > 0))) AS cut FROM s WHERE shared < mn)
SELECT t.doc, t.id, trim(t.t[k.cut + 1:], ' _-:') AS level FROM t JOIN k USING (doc) WHERE trim(t.t[k.cut + 1:], ' _-:') <> t.t AND len(list_filter(k.ts, lambda x: trim(x[k.cut + 1:], ' _-:') = '')) = 0""")
def f20(t):
    titles = t.L_title.selectExpr("page AS doc", "id", f"{level_titles('spark')} AS title")
    return tb.levels_from_titles(titles, ["doc"]).select("doc", "id", "level")


@query("U5", """
WITH r AS (SELECT document_id, door_type, row_index, door_tag, door_width, door_material FROM L_doors), tg AS (SELECT DISTINCT document_id, door_type, door_tag FROM r),
v AS (SELECT document_id, door_type, row_index, unnest([door_width, door_material]) AS w FROM r),
h AS (SELECT DISTINCT v.document_id, v.door_type, v.row_index FROM v JOIN tg o ON o.document_id = v.document_id AND o.door_type <> v.door_type AND o.door_tag = v.w
  WHERE NOT EXISTS (SELECT 1 FROM tg m WHERE m.document_id = v.document_id AND m.door_type = v.door_type AND m.door_tag = v.w)),
c AS (SELECT document_id, door_type, count(*) AS hits FROM h GROUP BY 1, 2), n AS (SELECT document_id, door_type, count(DISTINCT row_index) AS n FROM r GROUP BY 1, 2),
d AS (SELECT n.*, coalesce(hits >= 3 AND hits >= n * 0.5, false) AS drop_it FROM n LEFT JOIN c USING (document_id, door_type))
SELECT document_id, door_type FROM d WHERE NOT drop_it OR document_id IN (SELECT document_id FROM d GROUP BY 1 HAVING bool_and(drop_it))""")
def u5(t):
    rows = t.L_doors.select("document_id", "door_type", F.col("row_index").alias("row"), "door_tag").distinct()
    values = t.L_doors.select("document_id", "door_type", F.col("row_index").alias("row"), F.explode(F.array("door_width", "door_material")).alias("value"))
    return tb.drop_attached(rows, values, ["document_id"], ["door_type"])


@query("J24", """
WITH d AS (SELECT l_orderkey AS document_id, l_returnflag AS tbl, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index FROM lineitem),
s AS (SELECT document_id, tbl, CAST(ascii(tbl) AS BIGINT) AS page, count(*) + CASE WHEN document_id % 10 = 0 AND tbl = 'R' THEN 1 ELSE 0 END AS row_count FROM d GROUP BY 1, 2),
g AS (SELECT document_id FROM s GROUP BY 1 HAVING sum(row_count) = (SELECT max(row_index) + 1 FROM d WHERE d.document_id = s.document_id))
SELECT document_id, row_index, tbl AS "table" FROM d WHERE document_id IN (SELECT document_id FROM g)""")
def j24(t):
    w = F.row_number().over(tb_window())
    d = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("tbl"), (w - 1).cast("bigint").alias("row_index"))
    s = d.groupBy("document_id", F.col("tbl").alias("table")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("page", F.ascii("table").cast("bigint")).withColumn(
        "row_count", F.col("row_count") + F.when((F.col("document_id") % 10 == 0) & (F.col("table") == "R"), 1).otherwise(0))
    return tb.doors_by_order(s, d.drop("tbl")).select("document_id", "row_index", "table")


def tb_window():
    from pyspark.sql import Window as W
    return W.partitionBy("l_orderkey").orderBy("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")


@query("W21", """
WITH s AS (SELECT document_id, page, count(*) AS row_count FROM (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS page FROM lineitem) GROUP BY ALL)
SELECT document_id, page, row_count, CAST(coalesce(sum(row_count) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM s""")
def w21(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("bigint").alias("page")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table", F.col("page"))
    return tb.seq_running(s).select("document_id", "page", "row_count", F.col("_start").alias("first"))


@query("J21", r"""
WITH t AS (SELECT doc, page, id, title || '  PLAN' AS title FROM L_title), r AS (SELECT doc, page, lower(title) || ' plan' AS title FROM L_title WHERE id % 3 = 0)
SELECT id, doc, page FROM t WHERE (doc, page, trim(regexp_replace(upper(title), '\s+', ' ', 'g'))) NOT IN (SELECT doc, page, trim(regexp_replace(upper(title), '\s+', ' ', 'g')) FROM r)""")
def j21(t):
    tables = t.L_title.select("doc", "page", "id", F.concat("title", F.lit("  PLAN")).alias("title"))
    removed = t.L_title.filter("id % 3 = 0").select("doc", "page", F.concat(F.lower("title"), F.lit(" plan")).alias("title"))
    return tb.leave_out_removed(tables, removed, ["doc"]).select("id", "doc", "page")


@query("J10", "SELECT doc, page, line, w FROM L_tok WHERE lower(text) IN (SELECT DISTINCT lower(unnest(string_split(text, ' '))) FROM benchmark)")
def j10(t):
    tags = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("tag")).distinct()
    return t.L_tok.withColumn("tag", F.lower("text")).join(tags, "tag", "left_semi").select("doc", "page", "line", "w")


@query("J11", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j11(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("X18", """
WITH s AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
SELECT 'found' AS what, count(*) AS n FROM s JOIN f USING (k) UNION ALL SELECT 'missing', count(*) FROM s WHERE k NOT IN (SELECT k FROM f)
UNION ALL SELECT 'unscheduled', count(*) FROM f WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'ambiguous', count(*) FROM s JOIN f USING (k) WHERE n > 1""")
def x18(t):
    from mullion.operators import locate
    s = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("tag"))
    f = t.lineitem.filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("tag")).agg(F.count(F.lit(1)).alias("spots"))
    return locate.reconcile(s, f)


@query("X29", """
WITH r AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS tag FROM lineitem WHERE l_linenumber < 5), p AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS tag FROM lineitem WHERE l_suppkey % 3 > 0)
SELECT 'made up' AS what, doc, tag FROM r WHERE (doc, tag) NOT IN (SELECT doc, tag FROM p) UNION ALL SELECT 'missed', doc, tag FROM p WHERE (doc, tag) NOT IN (SELECT doc, tag FROM r)""")
def x29(t):
    from mullion.operators import locate
    cols = [F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("tag")]
    return locate.unconfirmed(t.lineitem.filter("l_linenumber < 5").select(*cols), t.lineitem.filter("l_suppkey % 3 > 0").select(*cols), ["doc"])


@query("J30", """
WITH r AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS VARCHAR) AS read, l_partkey * 1000 + l_suppkey AS shape FROM lineitem WHERE l_quantity > 5),
s AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_linenumber AS VARCHAR) AS read FROM lineitem WHERE l_returnflag <> 'A')
SELECT doc, read, min(shape) AS shape FROM r WHERE (doc, read) IN (SELECT doc, read FROM s) GROUP BY 1, 2 HAVING count(*) = 1""")
def j30(t):
    from mullion.operators import locate
    r = t.lineitem.filter("l_quantity > 5").selectExpr("l_orderkey AS doc", "CAST(l_linenumber AS STRING) AS read", "l_partkey * 1000 + l_suppkey AS shape")
    tags = t.lineitem.filter("l_returnflag <> 'A'").selectExpr("l_orderkey AS doc", "CAST(l_linenumber AS STRING) AS read")
    return locate.name_unique(r, tags, ["doc"])


@query("J27", """
WITH b AS (SELECT doc, id AS pos, page // 3 AS page, number || CASE WHEN id % 2 = 0 THEN ' - ' ELSE ': ' END || title AS title FROM L_title),
e AS (SELECT doc, pos, page, regexp_extract(title, '^([A-Za-z]{1,3}[-.]?[0-9]{1,3}(?:[.\\-][0-9]{1,3})?[A-Za-z]?)(?:\\s*[-:]\\s*|\\s+)(.+)$', 1) AS number FROM b),
c AS (SELECT doc, page FROM e WHERE number <> '' GROUP BY 1, 2 HAVING count(DISTINCT number) > 1)
SELECT doc, number, min(pos) AS pos, arg_min(page, pos) AS page FROM e WHERE number <> '' AND (doc, page) NOT IN (SELECT doc, page FROM c) GROUP BY 1, 2""".replace("\\\\", "\\"))
def j27(t):
    b = t.L_title.selectExpr("doc", "id AS pos", "page DIV 3 AS page", "concat(number, IF(id % 2 = 0, ' - ', ': '), title) AS title")
    return sh.from_bookmarks(b, ["doc"]).select("doc", "number", "pos", "page")


@query("J26", """
WITH l AS (SELECT upper(regexp_replace(number, '[-. ]', '', 'g')) AS number, min(id) AS entry FROM L_title WHERE id % 5 = 0 GROUP BY 1),
i AS (SELECT doc, page, id AS pos, number AS text, 8 + id % 7 AS size FROM L_title)
SELECT doc, page, upper(regexp_replace(text, '[-. ]', '', 'g')) AS number, entry FROM i JOIN l ON l.number = upper(regexp_replace(text, '[-. ]', '', 'g'))
QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY size DESC, pos) = 1""")
def j26(t):
    listed = t.L_title.filter("id % 5 = 0").groupBy(text.norm_number(F.col("number")).alias("number")).agg(F.min("id").alias("entry"))
    items = t.L_title.selectExpr("doc", "page", "id AS pos", "number AS text", "8 + id % 7 AS size")
    return sh.own_numbers(items, listed, ["doc", "page"]).select("doc", "page", "number", "entry")


@query("J38", """
WITH e AS (SELECT o_orderpriority AS doc, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, 'N' || o_orderkey AS number FROM orders),
p AS (SELECT doc, k + 3 AS page, CASE WHEN k % 7 < 2 THEN number ELSE '' END AS number FROM e WHERE k % 11 <> 5),
a AS (SELECT e.doc, e.k, e.number, p.page FROM e LEFT JOIN p ON p.doc = e.doc AND p.number = e.number),
n AS (SELECT a.*, (SELECT arg_min({'k': b.k, 'page': b.page}, abs(b.k - a.k) * 2 + CASE WHEN b.k <= a.k THEN 0 ELSE 1 END) FROM a b WHERE b.doc = a.doc AND b.page IS NOT NULL AND b.k BETWEEN a.k - 12 AND a.k + 12) AS near FROM a),
g AS (SELECT *, near.page + k - near.k AS guess FROM n)
SELECT g.doc, g.k, g.number, coalesce(g.page, p.page) AS page, g.page IS NULL AND p.page IS NOT NULL AS counted FROM g LEFT JOIN p ON p.doc = g.doc AND p.page = g.guess AND p.number = '' AND g.page IS NULL""")
def j38(t):
    from mullion.operators import sequence as seq
    o = t.orders.selectExpr("o_orderpriority AS doc", "o_orderkey", "concat('N', o_orderkey) AS number")
    e = seq.running(o, ["doc"], F.floor(F.col("o_orderkey") / 4096), ["o_orderkey"], {"k": ("sum", F.lit(1))}).select("doc", F.col("k").cast("bigint").alias("k"), "number")
    p = e.filter("k % 11 <> 5").selectExpr("doc", "k + 3 AS page", "IF(k % 7 < 2, number, '') AS number")
    return sh.locate_index(e, p, ["doc"])


@query("J39", """
WITH i AS (SELECT doc, page, id AS pos, unnest([number, title, 'GENERAL NOTES ' || (id % 3)]) AS text, unnest([8 + id % 9, 9 + id % 5, 10 + id % 4]) AS size FROM L_title),
d AS (SELECT doc, page, text, min({'s': -size, 'p': pos}) AS o FROM i WHERE trim(text) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY o, text) AS rn FROM d),
k AS (SELECT *, regexp_matches(text, '^[A-Z]{1,3}[-.]?[0-9]{1,3}([-.][0-9]{1,3})?[A-Za-z]?$') AS num, NOT (text LIKE '%KEYNOTE%' OR text LIKE '%LEGEND%' OR text LIKE '%SYMBOLS%' OR text LIKE '%GENERAL NOTES%') AS clean,
  regexp_matches(text, '(^|[^A-Z])(FLOOR PLAN|ROOF PLAN|SITE PLAN|LEVEL|PLAN)S?($|[^A-Z])') OR text LIKE '%SCHEDULE%' AS plan FROM r WHERE rn <= 12),
n AS (SELECT doc, page, arg_min(text, rn) FILTER (WHERE num) AS number, arg_min(text, rn) FILTER (WHERE clean AND plan) AS t1 FROM k GROUP BY ALL),
o AS (SELECT k.doc, k.page, arg_min(text, rn) AS t2 FROM k JOIN n USING (doc, page) WHERE clean AND length(text) > 4 AND text IS DISTINCT FROM n.number GROUP BY ALL)
SELECT doc, page, coalesce(number, '') AS number, coalesce(t1, t2, '') AS title FROM n LEFT JOIN o USING (doc, page)""")
def j39(t):
    i = t.L_title.select("doc", "page", F.col("id").alias("pos"), F.explode(F.array(
        F.struct(F.col("number").alias("text"), (8 + F.col("id") % 9).alias("size")), F.struct(F.col("title").alias("text"), (9 + F.col("id") % 5).alias("size")),
        F.struct(F.concat(F.lit("GENERAL NOTES "), F.col("id") % 3).alias("text"), (10 + F.col("id") % 4).alias("size")))).alias("e")).select("doc", "page", "pos", "e.*")
    return sh.name_sheets(i, ["doc", "page"])


def legend(engine):
    said = ["STUD WALL WITH 5/8\" GYP EACH SIDE", "CMU 8\" 1-HOUR RATED", "PROVIDE LANDSCAPE FABRIC", "GWB ON 25 GA STUD, 2 HR", "CONCRETE SLAB"]
    sym = ["A1", "B2", "3", "PS", "12A"]
    return f"concat({pick(sym, 'id % 5', engine)}, ' - ', {pick(said, '(id DIV 5) % 5' if engine == 'spark' else '(id // 5) % 5', engine)}, CASE WHEN page % 2 = 0 THEN ' TYP' ELSE '' END)"


_LEG = f"""i AS (SELECT doc, page, id, {legend('duckdb')} AS text, CASE WHEN page % 4 = 0 THEN 'PARTITION TYPES' ELSE title END AS title FROM L_title),
r AS (SELECT doc, page, regexp_extract(text, '^([0-9]{{1,2}}[A-Z]?(?:[.][0-9])?|[A-Z][0-9]{{0,2}}(?:[.][0-9])?)\\s*[_:-]\\s*(.{{10,}})$', 1) AS symbol, trim(regexp_extract(text, '^([0-9]{{1,2}}[A-Z]?(?:[.][0-9])?|[A-Z][0-9]{{0,2}}(?:[.][0-9])?)\\s*[_:-]\\s*(.{{10,}})$', 2)) AS said, text, title FROM i)"""


@query("F30", f"""WITH {_LEG}, c AS (SELECT DISTINCT doc, page FROM i WHERE regexp_matches(upper(title), '(WALL|PARTITION)\\s*(TYPE|KEY|LEGEND|SCHEDULE|ASSEMBL)')),
k AS (SELECT DISTINCT doc, page, symbol, said FROM r WHERE symbol <> '' AND regexp_matches(said, 'STUD|GYP|GWB|CMU|CONCRETE') AND regexp_matches(said, '[0-9]\\s*"|[0-9]+\\s*GA\\b') AND (doc, page) IN (SELECT doc, page FROM c)),
g AS (SELECT doc, page FROM k GROUP BY 1, 2 HAVING count(DISTINCT symbol) >= 3)
SELECT doc, symbol, said AS description, CASE WHEN regexp_matches(said, '[0-9]+\\s*[-\\s]?\\s*(HR|HOUR)') THEN regexp_extract(said, '([0-9]+)\\s*[-\\s]?\\s*(HR|HOUR)', 1) || ' HR' ELSE '' END AS rating
FROM k WHERE (doc, page) IN (SELECT doc, page FROM g) QUALIFY row_number() OVER (PARTITION BY doc, symbol ORDER BY length(said) DESC, said DESC) = 1""")
def f30(t):
    items = t.L_title.selectExpr("doc", "page", f"{legend('spark')} AS text")
    titles = t.L_title.selectExpr("doc", "page", "IF(page % 4 = 0, 'PARTITION TYPES', title) AS title")
    return sh.legend_types(items, titles, ["doc", "page"], ["doc"])


@query("O7", f"""WITH {_LEG}, s AS (SELECT doc, page, count(*) AS sized FROM i WHERE regexp_matches(text, 'STUD|GYP|GWB|CMU|CONCRETE') AND regexp_matches(text, '[0-9]\\s*"|[0-9]+\\s*GA\\b') GROUP BY 1, 2),
t AS (SELECT DISTINCT doc, page, page % 4 = 0 AS titled FROM i)
SELECT doc, page, titled, coalesce(sized, 0) AS sized FROM t LEFT JOIN s USING (doc, page) WHERE titled OR coalesce(sized, 0) >= 3 ORDER BY titled DESC, sized DESC, page DESC""")
def o7(t):
    items = t.L_title.selectExpr("doc", "page", f"{legend('spark')} AS text")
    titles = t.L_title.selectExpr("doc", "page", "IF(page % 4 = 0, 'PARTITION TYPES', 'PLAN') AS title").distinct()
    return sh.legend_candidates(items, titles, ["doc", "page"]).select("doc", "page", "titled", "sized").orderBy(F.desc("titled"), F.desc("sized"), F.desc("page"))


@query("O4", """
WITH s AS (SELECT doc, page, max(CASE WHEN page % 5 < 2 THEN id % 40 ELSE 0 END) AS score, count(*) AS rules, page % 3 > 0 OR doc = '1-URGENT' AS is_foreign FROM L_title GROUP BY ALL),
o AS (SELECT doc, bool_or(NOT is_foreign) AS own FROM s GROUP BY doc)
SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN score > 0 THEN 0 ELSE 1 END, CASE WHEN score > 0 THEN -score ELSE -rules END, page) AS rn FROM s JOIN o USING (doc) WHERE NOT is_foreign OR NOT own QUALIFY rn <= 4""")
def o4(t):
    s = t.L_title.groupBy("doc", "page").agg(F.max(F.expr("IF(page % 5 < 2, id % 40, 0)")).alias("score"), F.count(F.lit(1)).alias("rules")).withColumn(
        "foreign", F.expr("page % 3 > 0 OR doc = '1-URGENT'"))
    return sh.fallback_pages(s, ["doc"], 4).select("doc", "page", "rn")


@query("A36", """
WITH w AS (SELECT document_id, row_index, CASE WHEN suppkey % 9 = 0 THEN NULL ELSE CAST(door_width AS BIGINT) % 12 + 1 END AS ft FROM L_doors),
m AS (SELECT document_id, list_sort(list(ft) FILTER (WHERE ft IS NOT NULL)) AS v FROM w GROUP BY 1)
SELECT w.document_id, w.row_index, round(CASE WHEN ft IS NULL OR len(v) = 0 THEN 36.0 ELSE 36.0 * ft / v[CAST(len(v) // 2 + 1 AS INT)] END, 6) AS span FROM w JOIN m USING (document_id)""")
def a36(t):
    from mullion.operators import locate
    w = t.L_doors.selectExpr("document_id", "row_index", "IF(suppkey % 9 = 0, 'SEE PLAN', concat(CAST(door_width AS BIGINT) % 12 + 1, '\\' - 0\"')) AS width")
    return locate.door_spans(w, ["document_id"], 36.0).select("document_id", "row_index", F.round("span", 6).alias("span"))


@query("A38", """
WITH s AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 6 AS sheet, 'A' || (l_suppkey % 6) AS name, l_linenumber AS tag FROM lineitem)
SELECT doc, tag, string_agg(DISTINCT name, '/' ORDER BY name) AS sheets FROM s WHERE (doc, tag) NOT IN (SELECT doc, tag FROM s WHERE sheet < 2) GROUP BY 1, 2""")
def a38(t):
    s = t.lineitem.selectExpr("l_orderkey AS doc", "l_suppkey % 6 AS sheet", "concat('A', l_suppkey % 6) AS name", "l_linenumber AS tag").distinct()
    return sh.unscanned_tags(s, s.filter("sheet < 2"), ["doc"])


@query("A16", r"""
WITH p AS (SELECT *, (x0 + x1) / 2 AS cx, coalesce(regexp_matches(text, '^[0-9]+$') AND TRY_CAST(text AS INT) % 2 = 0, false) AS is_tag, page % 3 = 0 AND line % 2 = 0 AS room, line * 100000 + w AS pos FROM L_plan WHERE w < 60),
n AS (SELECT doc, page, count(*) AS printed, count(*) FILTER (WHERE NOT room) AS matched FROM p WHERE is_tag GROUP BY ALL),
b AS (SELECT doc, page, round(size, 1) AS s, count(*) AS c, min(pos) AS first FROM p WHERE is_tag AND NOT room GROUP BY ALL), u AS (SELECT doc, page, s FROM b QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY c DESC, first) = 1),
o AS (SELECT doc, page, text, min(size) AS size FROM p GROUP BY ALL HAVING count(*) = 1), l AS (SELECT doc, page, list_sort(list(size)) AS v FROM o WHERE length(text) >= 3 AND regexp_matches(text, '\p{L}') GROUP BY ALL),
g AS (SELECT DISTINCT doc, page FROM p)
SELECT doc, page, CASE WHEN coalesce(matched, 0) >= 4 THEN s WHEN coalesce(matched, 0) < coalesce(printed, 0) THEN NULL ELSE v[CAST(len(v) // 2 + 1 AS INT)] END AS size FROM g LEFT JOIN n USING (doc, page) LEFT JOIN u USING (doc, page) LEFT JOIN l USING (doc, page)""".replace(" WHERE w < 60", ""))
def a16(t):
    items = t.L_plan.selectExpr("doc", "page", "text", "size", "line * 100000 + w AS pos", "text RLIKE '^[0-9]+$' AND try_cast(text AS INT) % 2 = 0 AS is_tag", "page % 3 = 0 AND line % 2 = 0 AS room")
    return sh.tag_size(items.withColumn("is_tag", F.coalesce("is_tag", F.lit(False))), ["doc", "page"])


@query("J25", """
WITH i AS (SELECT doc, page, line, w, x0, x1, (y0 + y1) / 2 AS cy, CASE WHEN w % 4 = 0 THEN 'A' || (100 + line) ELSE text END AS text, w % 4 = 0 AS num FROM L_tok),
c AS (SELECT doc, page, x0 FROM i WHERE num GROUP BY ALL HAVING count(*) >= 8),
b AS (SELECT n.doc, n.page, n.x0, n.line, n.text AS number, o.text AS title, o.num, row_number() OVER (PARTITION BY n.doc, n.page, n.x0, n.line ORDER BY o.x0) AS rn FROM (SELECT * FROM i WHERE num AND (doc, page, x0) IN (SELECT * FROM c)) n
  JOIN i o ON o.doc = n.doc AND o.page = n.page AND o.line = n.line AND o.x0 >= n.x0 + 24 AND o.x0 - (n.x0 + 24) <= 120 WHERE o.num OR regexp_matches(o.text, '[A-Za-z]{3}')),
f AS (SELECT * FROM b WHERE rn = 1 AND NOT num), k AS (SELECT doc, page, x0 FROM f GROUP BY ALL HAVING count(*) >= 8)
SELECT doc, page, x0 AS "column", number, title FROM f WHERE (doc, page, x0) IN (SELECT doc, page, x0 FROM k)""")
def j25(t):
    items = t.L_tok.withColumn("num", F.col("w") % 4 == 0).withColumn("text", F.when(F.col("num"), F.concat(F.lit("A"), 100 + F.col("line"))).otherwise(F.col("text"))).withColumn(
        "x1", F.when(F.col("num"), F.col("x0") + 24).otherwise(F.col("x1"))).withColumn("horizontal", F.lit(True))
    return sh.index_entries(items, ["doc", "page"], lambda c: c.rlike(r"^A\d{3}$")).select("doc", "page", "column", "number", "title")
