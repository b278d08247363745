"""Pricing: makers, models, verdicts and the cost reports."""

from pyspark.sql import functions as F

from mullion.functions import text
from mullion.lenses import pick
from mullion.operators import prices as pr
from mullion.registry import query
from mullion.runtime import small

_KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
_PK = f"{_KEY.format('model')} || '|' || {_KEY.format('finish')} || '|' || {_KEY.format('size')}"
_STORED = f"""stored AS (SELECT manufacturer, {_PK} AS product_key, min(id) AS id, arg_min(CASE WHEN id % 5 < 3 THEN list_price END, id * 10) AS lp0 FROM L_price GROUP BY 1, 2),
st AS (SELECT manufacturer, product_key, id, CASE WHEN id % 5 < 3 THEN 900.0 + id / 10.0 END AS list_price, id % 3 = 0 AS verified,
   ['agreed', 'disagree', 'one_answer', 'unsure'][CAST(id % 4 AS INT) + 1] AS verdict FROM stored)"""


def stored_prices(t):
    p = pr.product_key(t.L_price).groupBy("manufacturer", "product_key").agg(F.min("id").alias("id"))
    return p.selectExpr("manufacturer", "product_key", "id", "CASE WHEN id % 5 < 3 THEN 900.0D + id / 10.0D END AS list_price", "id % 3 = 0 AS verified",
                        f"{pick(['agreed', 'disagree', 'one_answer', 'unsure'], 'id % 4', 'spark')} AS verdict")


_CODES = """brands AS (SELECT DISTINCT p_brand AS b, CAST(substr(p_brand, 7) AS BIGINT) AS k FROM part),
makers AS (SELECT b AS manufacturer FROM brands WHERE k <= 15),
codes AS (SELECT 'BRAND' || k AS code, CASE WHEN k % 2 = 0 THEN 'Brand#' || (k - 14) ELSE 'Brand#' || (k - 15) END AS manufacturer,
   CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'ai' ELSE 'user' END ELSE 'standard' END AS source, CASE WHEN k % 2 = 0 THEN k % 4 = 0 ELSE true END AS verified
   FROM brands WHERE k BETWEEN 16 AND 22)"""


def brands(t):
    return t.part.select(F.col("p_brand").alias("b"), F.substring("p_brand", 7, 9).cast("bigint").alias("k")).distinct()


def codes(t):
    b = brands(t)
    standard = b.filter("k BETWEEN 16 AND 22").selectExpr("concat('BRAND', k) AS code", "concat('Brand#', k - 15) AS manufacturer", "'standard' AS source", "true AS verified")
    stored = b.filter("k BETWEEN 16 AND 22 AND k % 2 = 0").selectExpr(
        "concat('BRAND', k) AS code", "concat('Brand#', k - 14) AS manufacturer", "IF(k % 4 = 0, 'ai', 'user') AS source", "k % 4 = 0 AS verified")
    return standard, stored


@query("U6", f"WITH {_CODES} SELECT * FROM codes")
def u6(t):
    return pr.maker_codes(*codes(t)).select("code", "manufacturer", "source", "verified")


@query("J15", f"""
WITH {_CODES}, w AS (SELECT DISTINCT lower(manufacturer) AS written, {_KEY.format('manufacturer')} AS code FROM L_items)
SELECT w.written, coalesce(m.manufacturer, c.manufacturer) AS manufacturer,
  CASE WHEN m.manufacturer IS NOT NULL THEN 'name' WHEN c.source = 'ai' THEN 'ai' WHEN c.code IS NOT NULL THEN 'table' ELSE 'none' END AS found_by,
  CASE WHEN m.manufacturer IS NOT NULL THEN true ELSE coalesce(c.verified, false) END AS verified
FROM w LEFT JOIN makers m ON {_KEY.format('m.manufacturer')} = w.code LEFT JOIN codes c ON c.code = w.code""")
def j15(t):
    makers = brands(t).filter("k <= 15").select(F.col("b").alias("manufacturer"))
    return pr.resolve_makers(t.L_items.select(F.lower("manufacturer").alias("written")), makers, pr.maker_codes(*codes(t)))


@query("J16", f"""
WITH p AS (SELECT DISTINCT manufacturer, 'NEW ' || model || ' KIT' AS model FROM L_items),
w AS (SELECT *, string_split(model, ' ') AS ws FROM p), i AS (SELECT *, unnest(range(1, len(ws) + 1)) AS a FROM w), s AS (SELECT *, unnest(range(a, least(a + 5, len(ws) + 1))) AS b FROM i),
k AS (SELECT manufacturer, model, {_KEY.format("array_to_string(ws[a:b], '')")} AS match_key FROM s),
base AS (SELECT DISTINCT manufacturer, match_key FROM L_price WHERE kind = 'base')
SELECT manufacturer, model, match_key FROM k JOIN base USING (manufacturer, match_key) WHERE length(match_key) >= 2
QUALIFY row_number() OVER (PARTITION BY manufacturer, model ORDER BY length(match_key) DESC, match_key DESC) = 1""")
def j16(t):
    p = t.L_items.select("manufacturer", F.concat(F.lit("NEW "), "model", F.lit(" KIT")).alias("model")).distinct()
    return pr.match_models(p, t.L_price)


_FIN = ["626", "US26D", "689", "SP28", "612", "US10", "BRASS", "605"]


@query("J17", f"""
WITH a AS (SELECT p_partkey, {pick(_FIN, 'p_partkey % 8', 'duckdb')} AS f FROM part), b AS (SELECT p_partkey, {pick(_FIN, '(p_partkey // 8) % 8', 'duckdb')} AS f FROM part),
g AS (SELECT * FROM (VALUES ('626', 1), ('US26D', 1), ('689', 2), ('SP28', 2), ('612', 3), ('US10', 3), ('BRASS', 4), ('605', 5)) v(f, g))
SELECT b.f AS finish, count(DISTINCT a.p_partkey) AS n FROM a JOIN g ga ON ga.f = a.f JOIN g gb ON gb.g = ga.g JOIN b ON b.f = gb.f GROUP BY b.f""")
def j17(t):
    a = t.part.select(F.expr(pick(_FIN, "p_partkey % 8", "spark")).alias("f")).groupBy(text.finish_group(F.col("f")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    b = t.part.select(F.expr(pick(_FIN, "(p_partkey DIV 8) % 8", "spark")).alias("finish")).distinct().withColumn("g", text.finish_group(F.col("finish")))
    return b.join(a, "g").select("finish", "n")


_STATUS = f"""i AS (SELECT *, {_PK} AS product_key FROM (SELECT id, manufacturer, finish, size, CASE WHEN id % 11 = 0 THEN model || 'X' ELSE model END AS model FROM L_items)),
s AS (SELECT i.id, i.manufacturer, i.product_key, CASE WHEN CAST(substr(i.manufacturer, 7) AS BIGINT) > 20 THEN 'book_not_loaded' WHEN st.product_key IS NULL THEN 'not_found'
   WHEN st.list_price IS NULL THEN 'needs_review' WHEN st.verified THEN 'priced' ELSE 'needs_review' END AS status, st.list_price FROM i LEFT JOIN st USING (manufacturer, product_key))"""


def statuses(t):
    items = t.L_items.select("id", "manufacturer", "finish", "size", F.when(F.col("id") % 11 == 0, F.concat("model", F.lit("X"))).otherwise(F.col("model")).alias("model"))
    makers = brands(t).filter("k <= 20").select(F.col("b").alias("manufacturer"))
    return pr.item_status(items, stored_prices(t), makers)


@query("J18", f"WITH {_STORED}, {_STATUS} SELECT id, product_key, status, round(list_price, 6) AS list_price FROM s")
def j18(t):
    return statuses(t).select("id", "product_key", "status", F.round("list_price", 6).alias("list_price"))


@query("A13", f"WITH {_STORED}, {_STATUS} SELECT status, count(*) AS n FROM s GROUP BY status")
def a13(t):
    return statuses(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("A14", f"""
SELECT {_KEY.format('manufacturer')} AS maker_key, arg_min(trim(manufacturer), id) AS written, count(*) AS items, count(DISTINCT {_PK}) AS products FROM L_items GROUP BY 1""")
def a14(t):
    return pr.groups(t.L_items)


@query("A15", f"""
WITH p AS (SELECT manufacturer, {_PK} AS product_key, min(id) AS first_id, count(*) AS items FROM L_items GROUP BY 1, 2)
SELECT manufacturer, product_key, first_id, items, 'P' || row_number() OVER (PARTITION BY manufacturer ORDER BY first_id) AS key FROM p""")
def a15(t):
    return pr.products(t.L_items).select("manufacturer", "product_key", "first_id", "items", "key")


@query("A34", f"""
WITH {_CODES}, r AS (SELECT lower(i.manufacturer) AS written, {_PK} AS pk, coalesce(m.manufacturer, c.manufacturer, '') AS maker FROM L_items i
  LEFT JOIN makers m ON {_KEY.format('m.manufacturer')} = {_KEY.format('i.manufacturer')} LEFT JOIN codes c ON c.code = {_KEY.format('i.manufacturer')})
SELECT maker, string_agg(DISTINCT written, ',' ORDER BY written) AS written, count(*) AS items, count(DISTINCT pk) AS products FROM r GROUP BY maker""")
def a34(t):
    makers = brands(t).filter("k <= 15").select(F.col("b").alias("manufacturer"))
    items = pr.product_key(t.L_items).withColumn("written", F.lower("manufacturer")).drop("manufacturer")
    found = pr.resolve_makers(items, makers, pr.maker_codes(*codes(t)))
    return (items.join(small(found), "written").groupBy(F.coalesce("manufacturer", F.lit("")).alias("maker"))
            .agg(F.array_join(F.array_sort(F.collect_set("written")), ",").alias("written"), F.count(F.lit(1)).alias("items"), F.countDistinct("product_key").alias("products")))


def calls(t):
    return t.L_calls.withColumn("product_keys", F.array("key1", "key2"))


@query("A7", """
WITH a AS (SELECT model, count(*) AS calls, CAST(sum(usd) AS DOUBLE) AS usd, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in, CAST(sum(completion_tokens) AS BIGINT) AS tokens_out,
   count(*) FILTER (WHERE outcome = 'cut_off') AS cut_off FROM L_calls GROUP BY model),
b AS (SELECT model, count(*) FILTER (WHERE abs(total - truth) <= 0.005) AS r, count(*) FILTER (WHERE abs(total - truth) > 0.005) AS w, count(*) FILTER (WHERE total IS NULL) AS u
      FROM L_ans WHERE verified AND truth IS NOT NULL GROUP BY model)
SELECT coalesce(a.model, b.model) AS model, coalesce(calls, 0) AS calls, coalesce(usd, 0) AS usd, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out,
  coalesce(cut_off, 0) AS cut_off, coalesce(r, 0) AS "right", coalesce(w, 0) AS wrong, coalesce(u, 0) AS unsure, round(usd / calls, 6) AS usd_per_call, round(r / CAST(r + w AS DOUBLE), 3) AS accuracy
FROM a FULL JOIN b ON a.model = b.model""")
def a7(t):
    return pr.per_model(calls(t), t.L_ans).withColumn("usd_per_call", F.round("usd_per_call", 6))


@query("A8", """
WITH r AS (SELECT CASE WHEN user_id % 10 = 0 THEN '(no project)' ELSE CAST(user_id AS VARCHAR) END AS project, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 5 AS m,
   CAST(CAST(value AS DECIMAL(18,4)) / 100 AS DECIMAL(18,6)) AS usd FROM events)
SELECT project, count(*) AS runs, CAST(sum(k) AS BIGINT) AS items, CAST(sum(usd) AS DOUBLE) AS usd, CAST(sum(m) AS BIGINT) AS verified, CAST(sum(k) AS BIGINT) AS agreed, CAST(0 AS BIGINT) AS disagree,
  CAST(sum(m + 1) AS BIGINT) AS one_answer, CAST(0 AS BIGINT) AS unsure, round(CAST(sum(usd) AS DOUBLE) / nullif(sum(k), 0), 6) AS usd_per_item FROM r GROUP BY project""")
def a8(t):
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    runs = t.events.selectExpr("CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS project_id", f"{k} AS items",
                               "CAST(CAST(value AS DECIMAL(18,4)) / 100 AS DECIMAL(18,6)) AS usd",
                               f"to_json(map('verified', event_id % 5, 'agreed', {k}, 'one_answer', event_id % 5 + 1)) AS counts")
    return pr.per_project(runs).withColumn("usd_per_item", F.round("usd_per_item", 6))


@query("A9", f"""
WITH {_STORED}, a AS (SELECT manufacturer, count(*) AS calls, CAST(sum(usd) AS DOUBLE) AS usd FROM L_calls GROUP BY 1),
b AS (SELECT manufacturer, count(*) FILTER (WHERE verdict = 'agreed') AS agreed, count(*) FILTER (WHERE verdict = 'disagree') AS disagree, count(*) FILTER (WHERE verdict = 'one_answer') AS one_answer,
  count(*) FILTER (WHERE verdict = 'unsure') AS unsure, count(*) FILTER (WHERE verified) AS verified FROM st GROUP BY 1)
SELECT coalesce(a.manufacturer, b.manufacturer) AS manufacturer, coalesce(calls, 0) AS calls, coalesce(usd, 0) AS usd, coalesce(agreed, 0) AS agreed, coalesce(disagree, 0) AS disagree,
  coalesce(one_answer, 0) AS one_answer, coalesce(unsure, 0) AS unsure, coalesce(verified, 0) AS verified, coalesce(agreed + disagree + one_answer + unsure, 0) AS products,
  round(coalesce(usd, 0) / nullif(coalesce(agreed + disagree + one_answer + unsure, 0), 0), 6) AS usd_per_product FROM a FULL JOIN b ON a.manufacturer = b.manufacturer""")
def a9(t):
    return pr.per_maker(t.L_calls, stored_prices(t)).withColumn("usd_per_product", F.round("usd_per_product", 6))


@query("A10", f"""
WITH s AS (SELECT manufacturer, unnest([key1, key2]) AS product_key, usd / 2 AS share FROM L_calls WHERE step <> 'identify'),
p AS (SELECT 'Brand#' || (id % 25 + 1) AS manufacturer, 'K' || (id % 100) AS product_key, min(id) AS id FROM L_price GROUP BY 1, 2)
SELECT manufacturer, product_key, CASE WHEN any_value(id) IS NULL THEN '' ELSE 'V' || (any_value(id) % 4) END AS verdict, any_value(id) * 1.5 AS list_price, round(CAST(sum(share) AS DOUBLE), 6) AS usd
FROM s LEFT JOIN p USING (manufacturer, product_key) GROUP BY 1, 2""")
def a10(t):
    p = t.L_price.selectExpr("concat('Brand#', id % 25 + 1) AS manufacturer", "concat('K', id % 100) AS product_key", "id").groupBy("manufacturer", "product_key").agg(F.min("id").alias("id"))
    prices = p.selectExpr("manufacturer", "product_key", "concat('V', id % 4) AS verdict", "id * 1.5D AS list_price")
    return pr.per_product(calls(t), prices).withColumn("usd", F.round("usd", 6))


_PAGES = "unnest([CAST(substr(key1, 2) AS BIGINT) % 7, CAST(substr(key2, 2) AS BIGINT) % 7])"


@query("A11", f"""
WITH s AS (SELECT model, CASE WHEN id % 3 > 0 THEN 'book' || (id % 4) END AS book, {_PAGES} AS page, usd / 2 AS share FROM L_calls WHERE step = 'B'),
k AS (SELECT *, CASE WHEN book IS NULL THEN 'unknown (several books in the call)' WHEN page > 4 THEN '' WHEN page % 2 = 0 THEN 'table' ELSE 'picture' END AS kind FROM s)
SELECT model, kind, count(*) AS pages, round(CAST(sum(share) AS DOUBLE), 6) AS usd, round(CAST(sum(share) AS DOUBLE) / count(*), 6) AS usd_per_page FROM k GROUP BY 1, 2""")
def a11(t):
    c = t.L_calls.selectExpr("model", "step", "usd", "IF(id % 3 > 0, array(concat('book', id % 4)), array('a', 'b')) AS books",
                             "array(CAST(substr(key1, 2) AS BIGINT) % 7, CAST(substr(key2, 2) AS BIGINT) % 7) AS pages")
    kinds = t.L_calls.selectExpr("concat('book', id % 4) AS book", "explode(sequence(0L, 4L)) AS page").distinct().selectExpr("book", "page", "IF(page % 2 = 0, 'table', 'picture') AS kind")
    return pr.per_page(c, kinds).select("model", "kind", "pages", F.round("usd", 6).alias("usd"), F.round("usd_per_page", 6).alias("usd_per_page"))


@query("A12", "SELECT id, step, model, CAST(CASE WHEN key1 = key2 THEN 1 ELSE 2 END AS BIGINT) AS products, prompt_tokens, CAST(usd AS DOUBLE) AS usd, outcome FROM L_calls")
def a12(t):
    return calls(t).select("id", "step", "model", F.size(F.array_distinct("product_keys")).cast("bigint").alias("products"), "prompt_tokens", F.col("usd").cast("double").alias("usd"), "outcome")


@query("A32", """
SELECT id, model, round(prompt_tokens / 1e6 * CASE model WHEN 'click' THEN 0.75 WHEN 'view' THEN 2.0 ELSE 10.0 END
  + completion_tokens / 1e6 * CASE model WHEN 'click' THEN 3.75 WHEN 'view' THEN 10.0 ELSE 50.0 END, 9) AS cost FROM L_calls""")
def a32(t):
    names = t.L_calls.select("model").distinct()
    rates = names.filter("model IN ('click', 'view', 'error')").selectExpr("model", "CASE model WHEN 'click' THEN 0.75D WHEN 'view' THEN 2.0D ELSE 10.0D END AS rate_in",
                                                                            "CASE model WHEN 'click' THEN 3.75D WHEN 'view' THEN 10.0D ELSE 50.0D END AS rate_out")
    return pr.cost(calls(t), rates).select("id", "model", F.round("cost", 9).alias("cost"))


@query("A28", """
WITH tok AS (SELECT DISTINCT book, page, w FROM (SELECT book, page, unnest(string_split(text, ' ')) AS w FROM L_book)),
r AS (SELECT book, page, line, text, string_split(text, ' ')[1] || CASE WHEN line % 3 = 0 THEN 'x' ELSE '' END AS price_text FROM L_book)
SELECT r.book, r.page, r.line, tok.w IS NOT NULL AS kept FROM r LEFT JOIN tok ON tok.book = r.book AND tok.page = r.page AND tok.w = r.price_text""")
def a28(t):
    tokens = t.L_book.select("book", "page", F.explode(F.split("text", " ")).alias("token"))
    rows = t.L_book.select("book", "page", "line", F.concat(F.get(F.split("text", " "), F.lit(0)), F.when(F.col("line") % 3 == 0, "x").otherwise("")).alias("price_text"))
    return pr.verify_printed(rows, tokens).select("book", "page", "line", "kept")


@query("A29", """
SELECT id, pdf_page, min(list_price) OVER w = max(list_price) OVER w AS kept FROM L_price WINDOW w AS (PARTITION BY pdf_page, manufacturer, finish, kind)""")
def a29(t):
    return pr.reject_conflicts(t.L_price, ["pdf_page", "manufacturer", "finish", "kind"]).select("id", "pdf_page", "kept")


_GAPS = """pages AS (SELECT book, page, count(*) AS prices FROM L_book GROUP BY ALL), used AS (SELECT book, page, count(*) AS read FROM L_book WHERE line % 4 = 0 AND page % 3 > 0 GROUP BY ALL)"""


@query("A30", f"""WITH {_GAPS} SELECT book, page, prices - coalesce(read, 0) AS unread, CASE WHEN coalesce(read, 0) = 0 THEN 'layout not read yet' ELSE 'prices on this page not read yet' END AS reason
FROM pages LEFT JOIN used USING (book, page) WHERE prices > coalesce(read, 0)""")
def a30(t):
    return gaps_of(t)


def gaps_of(t):
    pages = t.L_book.groupBy("book", "page").agg(F.count(F.lit(1)).alias("prices"))
    used = t.L_book.filter("line % 4 = 0 AND page % 3 > 0").groupBy("book", "page").agg(F.count(F.lit(1)).alias("read"))
    return pr.unread_gaps(pages, used)


@query("U9", f"""WITH {_GAPS}, g AS (SELECT book, page, coalesce(read, 0) AS read, prices FROM pages LEFT JOIN used USING (book, page) WHERE prices > coalesce(read, 0)),
o AS (SELECT book, page FROM g WHERE read = 0),
rows AS (SELECT book, page, line FROM L_book WHERE line % 4 = 0 AND page % 3 > 0 UNION ALL SELECT b.book, b.page, b.line FROM L_book b JOIN o USING (book, page) WHERE b.line % 2 = 0),
left_over AS (SELECT book, page FROM g WHERE read > 0 UNION ALL SELECT book, page FROM o WHERE page % 2 = 0)
SELECT 'row' AS part, book, page, count(*) AS n FROM rows GROUP BY ALL UNION ALL SELECT 'gap', book, page, count(*) FROM left_over GROUP BY ALL""")
def u9(t):
    rows = t.L_book.filter("line % 4 = 0 AND page % 3 > 0").select("book", "page", "line")
    gaps = gaps_of(t)
    more_gaps = t.L_book.filter("page % 2 = 0").select("book", "page").distinct().selectExpr("book", "page", "1L AS unread", "'prices on this page not read yet' AS reason")
    r, g = pr.chain_readers(rows, gaps, t.L_book.filter("line % 2 = 0").select("book", "page", "line"), more_gaps)
    n = F.count(F.lit(1)).alias("n")
    return (r.groupBy("book", "page").agg(n).select(F.lit("row").alias("part"), "book", "page", "n")
            .unionByName(g.groupBy("book", "page").agg(n).select(F.lit("gap").alias("part"), "book", "page", "n")))


@query("A37", """
WITH p AS (SELECT l_orderkey AS answer, CASE WHEN l_orderkey % 9 = 0 THEN 'not_on_pages' ELSE 'priced' END AS status, CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
  CAST(l_linenumber AS DECIMAL(10,2)) - CASE WHEN l_partkey % 40 = 0 THEN 7 ELSE 0 END AS units, l_partkey % 30 = 1 AS by_length, l_suppkey % 2 = 0 AS has_length FROM lineitem),
a AS (SELECT answer, status, sum(CAST(round(amount * CASE WHEN units > 0 THEN units ELSE 1 END, 2) AS DECIMAL(18,2))) AS s, bool_or(amount IS NULL OR units <= 0 OR by_length AND NOT has_length) AS bad FROM p GROUP BY 1, 2)
SELECT answer, CASE WHEN status = 'priced' AND bad THEN 'unclear' ELSE status END AS status, CASE WHEN status = 'priced' AND NOT bad THEN CAST(s AS DOUBLE) END AS total FROM a""")
def a37(t):
    p = t.lineitem.selectExpr("l_orderkey AS answer", "IF(l_orderkey % 9 = 0, 'not_on_pages', 'priced') AS status", "IF(l_suppkey % 50 = 0, NULL, CAST(l_extendedprice AS DECIMAL(18,2))) AS amount",
                              "CAST(l_linenumber AS DECIMAL(10,2)) - IF(l_partkey % 40 = 0, 7, 0) AS units", "l_partkey % 30 = 1 AS by_length", "l_suppkey % 2 = 0 AS has_length")
    return pr.assemble(p)


_CHECKED = """ans AS (SELECT l_orderkey AS product, 'm' || (l_linenumber % 3) AS model, bool_and(l_quantity > 10) AS priced, CAST(max(l_linenumber) // 3 AS DOUBLE) AS total, 'p' || (max(l_linenumber) // 4) AS parts FROM lineitem GROUP BY 1, 2)"""


def checked(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("product"), F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("model")).agg(
        F.min(F.col("l_quantity") > 10).alias("priced"), F.expr("CAST(max(l_linenumber) DIV 3 AS DOUBLE)").alias("total"), F.expr("concat('p', max(l_linenumber) DIV 4)").alias("parts"))


@query("X23", f"""WITH {_CHECKED}, f AS (SELECT product, count(*) AS n, count(DISTINCT (total, parts)) AS d, min(total) AS t FROM ans WHERE priced GROUP BY 1),
p AS (SELECT DISTINCT product FROM ans) SELECT product, CASE WHEN n >= 2 AND d = 1 THEN 'agreed' WHEN n >= 2 THEN 'disagree' WHEN n = 1 THEN 'one_answer' ELSE 'unsure' END AS verdict, CASE WHEN n >= 2 AND d = 1 THEN t END AS total
FROM p LEFT JOIN f USING (product)""")
def x23(t):
    return pr.judge_answers(checked(t))


@query("X33", f"""WITH {_CHECKED}, f AS (SELECT product, count(*) AS n, count(DISTINCT (total, parts)) AS d, min(total) AS t FROM ans WHERE priced GROUP BY 1),
w AS (SELECT product, string_agg(DISTINCT model || ': not priced', ',' ORDER BY model || ': not priced') AS why FROM ans WHERE NOT priced GROUP BY 1), p AS (SELECT DISTINCT product FROM ans)
SELECT product, 'K' || (product % 50) AS match_key, CASE WHEN n >= 2 AND d = 1 THEN 'agreed' WHEN n >= 2 THEN 'disagree' WHEN n = 1 THEN 'one_answer' ELSE 'unsure' END AS verdict,
  CASE WHEN n >= 2 AND d = 1 THEN t END AS list_price, CASE WHEN n >= 2 AND d = 1 THEN '' ELSE coalesce(why, '') END AS reasons FROM p LEFT JOIN f USING (product) LEFT JOIN w USING (product)""")
def x33(t):
    a = checked(t).withColumn("note", F.when(F.col("priced"), "").otherwise("not priced"))
    products = a.select("product").distinct().withColumn("product_key", F.expr("concat('K', product % 50, '|F|S')"))
    return pr.verdict_rows(products, pr.judge_answers(a), a).select("product", "match_key", "verdict", "list_price", F.array_join("reasons", ",").alias("reasons"))


@query("X24", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 7 = 0 OR l_partkey % 4 = 0 THEN 'unsure' WHEN l_suppkey % 5 = 0 THEN 'unsure' WHEN l_quantity < 3 THEN 'unsure' WHEN l_returnflag = 'R' THEN 'unsure'
  WHEN l_linestatus = 'F' AND l_suppkey % 3 = 0 THEN 'one_answer' WHEN l_suppkey % 11 = 0 THEN 'disagree' WHEN l_partkey % 4 = 1 THEN 'agreed' ELSE 'options' END AS verdict FROM lineitem""")
def x24(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pr.judge_agent(
        F.when(c("l_suppkey") % 7 == 0, "unclear").otherwise("priced"), c("l_partkey") % 4, c("l_suppkey") % 5 != 0, c("l_quantity") - 2, c("l_returnflag") != "R",
        ~((c("l_linestatus") == "F") & (c("l_suppkey") % 3 == 0)), c("l_suppkey") % 11 != 0).alias("verdict"))


@query("X26", f"""WITH {_CHECKED} SELECT product, CAST(total AS DOUBLE) AS price, string_agg(model, ',' ORDER BY model) AS read_by FROM ans WHERE total > 0 GROUP BY 1, 2""")
def x26(t):
    return pr.readings(checked(t)).select("product", F.col("price").cast("double").alias("price"), F.array_join("read_by", ",").alias("read_by"))


@query("X25", f"""
SELECT p_partkey, {_KEY.format("p_name || '-' || p_size")} AS key, CASE p_partkey % 3 WHEN 0 THEN 'US26D' WHEN 1 THEN '630' ELSE '' END AS finish,
  CASE WHEN p_partkey % 2 = 0 THEN 4.5 END AS high, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS wide FROM part""")
def x25(t):
    s = t.part.selectExpr("p_partkey", "concat(p_name, '-', p_size, IF(p_partkey % 2 = 0, concat(', 4 1/2 x ', p_size), ''), CASE p_partkey % 3 WHEN 0 THEN ' US26D' WHEN 1 THEN ' 630' ELSE '' END) AS s")
    # the size follows the model, so the size pattern must not take the model's own number
    s = s.withColumn("s", F.regexp_replace("s", r"-(\d+), ", "-$1 ,, "))
    got = s.select("p_partkey", pr.read_query(F.col("s")).alias("q"))
    return got.select("p_partkey", "q.key", "q.finish", F.get("q.size", F.lit(0)).alias("high"), F.get("q.size", F.lit(1)).alias("wide"))


@query("O2", """
WITH h AS (SELECT match_key, finish, size, CAST(list_price AS DOUBLE) AS list_price, min(id) AS id FROM L_price WHERE manufacturer = 'Brand#7' AND kind = 'base' AND starts_with(match_key, 'SMALL') GROUP BY ALL)
SELECT match_key, finish, size, list_price, id FROM h ORDER BY match_key <> 'SMALL', length(match_key), match_key, finish, size, list_price LIMIT 12""")
def o2(t):
    return pr.suggest(t.L_price, "Brand#7", "sma ll", 12).select("match_key", "finish", "size", F.col("list_price").cast("double").alias("list_price"), "id")


@query("J36", """
WITH c AS (SELECT DISTINCT manufacturer, model, upper(string_split(model, ' ')[2]) AS cand FROM L_items), b AS (SELECT DISTINCT 'Brand#' || (pdf_page % 25 + 1) AS maker, upper(string_split(model, ' ')[2]) AS code FROM L_price)
SELECT manufacturer, count(*) AS models, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.maker = c.manufacturer AND b.code = c.cand)) AS printed,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM b WHERE b.maker <> c.manufacturer AND b.code = c.cand)) AS elsewhere FROM c GROUP BY manufacturer""")
def j36(t):
    items = t.L_items.select("manufacturer", "model").distinct()
    book = t.L_price.selectExpr("concat('Brand#', pdf_page % 25 + 1) AS maker", "array(upper(split(model, ' ')[1])) AS models")
    from mullion.operators import books
    return books.printed_in_maps(items, book)


@query("X22")
def x22(t):
    products = t.L_items.select("manufacturer", "model", "finish", "size").distinct().withColumn("product", F.concat_ws("|", "manufacturer", "model", "finish", "size"))
    return pr.quote(products, t.L_price).select("product", "match_key", "status", F.col("list_price").cast("double").alias("list_price"), "options", F.array_join("left_over", ",").alias("left_over"))
