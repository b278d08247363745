"""Price-book queries."""

from pyspark.sql import functions as F

from mullion.functions import text
from mullion.operators import books as bk, prices as pr, pricetables as pt
from mullion.plans.pricing import _KEY
from mullion.registry import query

_KEYED = "upper(regexp_replace(replace(text, 'ß', 'ss'), '[0-9]+', '#', 'g'))"


@query("A22", f"""
WITH o AS (SELECT book, page, {_KEYED} AS key, bool_or(line < 2) AS edge FROM L_book GROUP BY ALL), n AS (SELECT book, key, count(*) AS n, count(*) FILTER (WHERE edge) AS e FROM o GROUP BY ALL),
p AS (SELECT book, count(DISTINCT page) AS pages FROM L_book GROUP BY 1 HAVING count(DISTINCT page) >= 4)
SELECT book, key FROM n JOIN p USING (book) WHERE n > pages * 0.4 OR e > pages * 0.2""")
def a22(t):
    return bk.furniture(t.L_book.withColumn("edge", F.col("line") < 2).withColumn("text", F.replace("text", F.lit("ß"), F.lit("ss"))))


_TOKENS = """i AS (SELECT book, page, line, w, text, 8 + length(text) % 3 AS size FROM (SELECT book, page, line, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS w FROM (SELECT book, page, line, string_split(text, ' ') AS ws FROM L_book)) WHERE text <> ''),
p AS (SELECT *, regexp_matches(text, '^\\$[0-9]{1,3}(,[0-9]{3})*(\\.[0-9][0-9])?$') OR regexp_matches(text, '^([0-9]{1,3}(,[0-9]{3})*|[0-9]{4,5})\\.[0-9][0-9]$') AS price, regexp_matches(text, '^[0-9]{1,4}$') AS no FROM i)"""


def book_tokens(t):
    return (t.L_book.select("book", "page", "line", F.posexplode(F.split("text", " ")).alias("w", "text")).filter("text <> ''")
            .withColumn("size", 8 + F.length("text") % 3))


@query("A23", rf"""WITH {_TOKENS}, b AS (SELECT book, page, median(size) AS body, max(line) AS last, count(*) FILTER (WHERE price) AS prices FROM p GROUP BY 1, 2),
big AS (SELECT p.*, 0 AS pref FROM p JOIN b USING (book, page) WHERE line <= last * 0.35 AND size >= body * 1.15 AND NOT price AND NOT no),
ld AS (SELECT book, page, min(line) AS line FROM (SELECT book, page, line FROM p GROUP BY ALL HAVING NOT bool_and(no)) GROUP BY 1, 2),
fst AS (SELECT p.*, 1 AS pref FROM p JOIN ld USING (book, page, line) WHERE NOT price), c AS (SELECT * FROM big UNION ALL SELECT * FROM fst),
h AS (SELECT book, page, text, min(line * 1000000 + w) AS pos FROM c WHERE pref = (SELECT min(pref) FROM c d WHERE d.book = c.book AND d.page = c.page) GROUP BY 1, 2, 3),
hd AS (SELECT book, page, string_agg(text, ' - ' ORDER BY pos) AS h FROM h GROUP BY 1, 2),
pl AS (SELECT book, page, line, bool_or(price) AS pr FROM p GROUP BY ALL),
k AS (SELECT p.book, p.page, trim(text, '*†,;:().') AS code, min(CASE WHEN pr THEN 0 ELSE 1 END * 1000000000000 + line * 1000000 + w) AS pos FROM p JOIN pl USING (book, page, line) GROUP BY 1, 2, 3),
ok AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY pos) AS rn FROM k WHERE regexp_matches(code, '^[A-Z0-9][A-Za-z0-9./#-]{{2,}}$') AND regexp_matches(code, '[0-9]') AND NOT regexp_matches(code, '^[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}$')
  AND NOT regexp_matches(code, '^([0-9]{{1,3}}(,[0-9]{{3}})*|[0-9]{{4,5}})\.[0-9][0-9]$') AND NOT regexp_matches(code, '^US[0-9]+[A-Z]{{0,3}}$|^(6[0-9][0-9]|7[0-2][0-9])[A-Za-z]{{0,2}}$')
  AND NOT regexp_matches(code, '^([0-9]+(-[0-9]+)+|(19|20)[0-9][0-9]|[0-9]{{1,3}})$|[a-z]{{2,}}$')), md AS (SELECT book, page, string_agg(code, ',' ORDER BY pos) AS models FROM ok WHERE rn <= 25 GROUP BY 1, 2)
SELECT book, page, trim(left(coalesce(h, ''), 150), ' -') AS heading, prices, coalesce(models, '') AS models FROM b LEFT JOIN hd USING (book, page) LEFT JOIN md USING (book, page)""")
def a23(t):
    return bk.page_map(book_tokens(t)).select("book", "page", "heading", "prices", F.array_join("models", ",").alias("models"))


_IDX = "CASE WHEN w % 3 = 0 THEN text WHEN w % 3 = 2 THEN 'AB' || (line + 1) WHEN page % 2 = 0 AND line = 0 AND w = 1 THEN 'PAGE' ELSE 'word' END"


@query("A24", f"""
WITH i AS (SELECT doc AS book, page, line, w, {_IDX} AS text FROM L_plan), pg AS (SELECT book, count(DISTINCT page) AS pages FROM i GROUP BY 1),
pr AS (SELECT a.book, a.page, a.text AS model, b.text AS printed_page FROM i a JOIN i b ON a.book = b.book AND a.page = b.page AND a.line = b.line AND b.w = a.w + 1 JOIN pg ON pg.book = a.book
  WHERE a.w % 3 = 2 AND length(a.text) >= 3 AND b.w % 3 = 0 AND CAST(b.text AS INT) <= pages * 2),
g AS (SELECT book, page FROM pr WHERE page % 2 = 0 AND (book, page) IN (SELECT book, page FROM i WHERE text = 'PAGE') GROUP BY 1, 2 HAVING count(*) >= 15)
SELECT book, page, model, printed_page, count(*) AS n FROM pr WHERE (book, page) IN (SELECT book, page FROM g) GROUP BY ALL""")
def a24(t):
    i = t.L_plan.selectExpr("doc AS book", "page", "line", "w", _IDX.replace("'AB' || (line + 1)", "concat('AB', line + 1)") + " AS text")
    pages = i.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    return bk.index_pages(i, pages).groupBy("book", "page", "model", "printed_page").agg(F.count(F.lit(1)).alias("n"))


@query("A31", """
WITH l AS (SELECT book, page, line, length(book) % 3 AS m FROM L_book), f AS (SELECT book, page FROM (SELECT DISTINCT book, page FROM L_book) QUALIFY row_number() OVER (PARTITION BY book ORDER BY page) <= 6),
e AS (SELECT book, arg_min(page % 28 + 1, page * 1000000 + line) AS d FROM l WHERE (book, page) IN (SELECT * FROM f) AND m = 0 AND line % 7 = 3 GROUP BY 1),
s AS (SELECT book, line % 9 + 1 AS mon, count(*) AS n, min(page * 1000000 + line) AS pos FROM l WHERE (book, page) IN (SELECT * FROM f) AND NOT (m = 0 AND line % 7 = 3) AND m < 2 GROUP BY 1, 2),
u AS (SELECT book, mon FROM s QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, pos) = 1)
SELECT coalesce(e.book, u.book) AS book, CAST(coalesce(make_date(2026, 3, CAST(d AS INT)), make_date(2026, CAST(mon AS INT), 1)) AS VARCHAR) AS effective_date FROM e FULL JOIN u ON e.book = u.book""")
def a31(t):
    said = F.concat(F.lit("Prices Effective March "), F.col("page") % 28 + 1, F.lit(", 2026"))
    m = F.length("book") % 3
    l = t.L_book.withColumn("text", F.when((m == 0) & (F.col("line") % 7 == 3), said).when(m < 2, F.concat(F.lit("0"), F.col("line") % 9 + 1, F.lit("/01/2026 x"))).otherwise("no date"))
    return bk.effective_date(l).withColumn("effective_date", F.col("effective_date").cast("string"))


@query("J19", """
WITH pg AS (SELECT DISTINCT book, page, CAST(page % 40 AS VARCHAR) AS pp FROM L_book), o AS (SELECT book, pp, min(page) AS pdf_page FROM pg GROUP BY 1, 2 HAVING count(*) = 1)
SELECT b.book, b.page, b.line, o.pdf_page FROM L_book b LEFT JOIN o ON o.book = b.book AND o.pp = CAST(b.line % 45 AS VARCHAR)""")
def j19(t):
    pages = t.L_book.select("book", "page", (F.col("page") % 40).cast("string").alias("printed_page")).distinct()
    index = t.L_book.select("book", F.col("page").alias("index_page"), "line", (F.col("line") % 45).cast("string").alias("printed_page"))
    return bk.place(index, pages).select("book", F.col("index_page").alias("page"), "line", "pdf_page")


@query("J20", f"""
WITH p AS (SELECT DISTINCT manufacturer AS maker, model AS product, {_KEY.format('model')} AS k1, {_KEY.format('name')} AS k2 FROM L_items), x AS (SELECT DISTINCT manufacturer AS maker, {_KEY.format('split_part(model, chr(45), 1)')} AS k, 'B1 p' || pdf_page AS place FROM L_price),
h AS (SELECT DISTINCT p.maker, product, place FROM p JOIN x ON x.maker = p.maker AND x.k IN (p.k1, p.k2)), r AS (SELECT *, row_number() OVER (PARTITION BY maker, product ORDER BY place) AS rn FROM h)
SELECT maker, product, string_agg(place, ',' ORDER BY place) AS hints FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def j20(t):
    products = t.L_items.select(F.col("manufacturer").alias("maker"), F.col("model").alias("product"), "name").distinct().withColumn(
        "keys", F.array_distinct(F.array(text.match_key(F.col("product")), text.match_key(F.col("name")))))
    index = t.L_price.select(F.col("manufacturer").alias("maker"), text.match_key(F.substring_index("model", "-", 1)).alias("match_key"), F.concat(F.lit("B1 p"), "pdf_page").alias("place")).distinct()
    return bk.index_hints(products, index).select("maker", "product", F.array_join("hints", ",").alias("hints"))


@query("J37", """
WITH s AS (SELECT DISTINCT book, page FROM L_book WHERE page % 5 = 0 AND line % 9 = 3), p AS (SELECT DISTINCT book, page FROM L_book)
SELECT book, page FROM p WHERE (book, page) IN (SELECT * FROM s) OR (book, page - 1) IN (SELECT * FROM s)""")
def j37(t):
    l = t.L_book.withColumn("text", F.when((F.col("page") % 5 == 0) & (F.col("line") % 9 == 3), "U/M is feet").otherwise("each"))
    return bk.rate_pages(l)


_PIECES = """i AS (SELECT doc, page, line, w, x0, x1, CASE WHEN line % 4 = 3 AND w % 3 = 0 THEN '$' || (w + 10) || '.00' WHEN line % 4 = 1 AND w % 2 = 0 THEN 'KX1' || w ELSE text END AS text FROM L_tok)"""


def piece_rows(t):
    return t.L_tok.withColumn("text", F.when((F.col("line") % 4 == 3) & (F.col("w") % 3 == 0) & (F.col("w") < 990), F.concat(F.lit("$"), F.col("w") + 10, F.lit(".00"))).when(
        (F.col("line") % 4 == 1) & (F.col("w") % 2 == 0), F.concat(F.lit("KX1"), "w")).otherwise(F.lit("Heading")))


@query("J35", """
WITH i AS (SELECT doc, page, line, w, x0, x1, line % 4 = 3 AND w % 3 = 0 AND w < 990 AS price, CASE WHEN line % 4 = 1 AND w % 2 = 0 THEN 'code' ELSE 'Heading' END AS kind FROM L_tok),
held AS (SELECT DISTINCT doc, page, line FROM i WHERE price), c AS (SELECT * FROM i WHERE (doc, page, line) NOT IN (SELECT * FROM held)),
m AS (SELECT p.doc, p.page, p.line, p.w, (p.x0 + p.x1) / 2 AS xc, g FROM (SELECT *, CAST(floor((x0 + x1) / 2 / 64) AS BIGINT) AS g FROM i WHERE price) p),
cc AS (SELECT *, unnest(range(CAST(floor((x0 - 4) / 64) AS BIGINT), CAST(floor((x1 + 4) / 64) AS BIGINT) + 1)) AS g FROM c),
h AS (SELECT m.doc, m.page, m.line, m.w, cc.line AS hl, string_agg(kind, ' ' ORDER BY cc.x0) AS h FROM m JOIN cc ON cc.doc = m.doc AND cc.page = m.page AND cc.g = m.g AND cc.line < m.line AND m.xc BETWEEN cc.x0 - 4 AND cc.x1 + 4 GROUP BY ALL),
n AS (SELECT doc, page, line, w, arg_max(h, hl) AS h FROM h WHERE h <> 'code' GROUP BY ALL)
SELECT m.doc, m.page, m.line, m.w, CASE WHEN contains(coalesce(n.h, ''), 'code') THEN 'mixed' ELSE coalesce(n.h, '') END AS heading FROM m LEFT JOIN n USING (doc, page, line, w)""")
def j35(t):
    h = bk.price_headings(piece_rows(t), ["doc", "page"], most=None)
    return h.select("doc", "page", "line", "w", F.when(F.col("heading").contains("KX1"), "mixed").otherwise(F.col("heading")).alias("heading"))


_Q = {"q1": "the of", "q2": "ere*", "q3": "le-la"}


@query("X27", r"""
WITH q AS (SELECT * FROM (VALUES ('q1', '(?i)(^|[^A-Za-z0-9])the[\s\-]*of($|[^A-Za-z0-9])'), ('q2', '(?i)(^|[^A-Za-z0-9])ere'), ('q3', '(?i)(^|[^A-Za-z0-9])le[\s\-]*la($|[^A-Za-z0-9])')) v(query, rx)),
h AS (SELECT query, doc, page, line, left(text, 300) AS text FROM L_line JOIN q ON regexp_matches(text, rx)), n AS (SELECT query, doc, page, count(*) AS matched FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY page) AS rn FROM n), s AS (SELECT *, row_number() OVER (PARTITION BY query, doc, page ORDER BY line) AS k FROM h),
l AS (SELECT query, doc, page, string_agg(text, '¦' ORDER BY line) AS lines FROM s WHERE k <= 4 GROUP BY ALL)
SELECT query, doc, page, matched, CASE WHEN rn <= 12 THEN rn END AS rn, CASE WHEN rn <= 12 THEN lines ELSE '' END AS lines FROM r LEFT JOIN l USING (query, doc, page)""")
def x27(t):
    return bk.search(t.L_line, _Q).select("query", "doc", "page", "matched", "rn", F.array_join("lines", "¦").alias("lines"))


@query("X30", """
WITH l AS (SELECT doc, page, line, string_agg(text, ' | ' ORDER BY x0) AS t FROM L_tok GROUP BY ALL)
SELECT doc, page, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY doc, page""")
def x30(t):
    return bk.page_text(t.L_tok.select("doc", "page", "x0", "y0", "y1", "text"), ["doc", "page"])


@query("S5", """
WITH pg AS (SELECT DISTINCT book, page % 4 + 1 AS pdf_page FROM L_book), r AS (SELECT DISTINCT book, 'M' || (length(book) % 5) AS maker FROM L_book WHERE length(book) % 7 > 0)
SELECT maker, string_agg(DISTINCT book, ',' ORDER BY book) AS books FROM pg JOIN r USING (book) WHERE pdf_page = 1 GROUP BY maker""")
def s5(t):
    pages = t.L_book.selectExpr("book", "page % 4 + 1 AS pdf_page").distinct()
    registry = t.L_book.filter("length(book) % 7 > 0").selectExpr("book", "concat('M', length(book) % 5) AS maker").distinct()
    return bk.mapped_books(pages, registry).select("maker", F.array_join("books", ",").alias("books"))


@query("U8", """
WITH o AS (SELECT manufacturer AS book, finish AS name, 'old' || min(id) AS body FROM L_price WHERE id % 2 = 0 GROUP BY 1, 2), n AS (SELECT manufacturer AS book, finish AS name, 'new' || min(id) AS body FROM L_price WHERE id % 3 = 0 GROUP BY 1, 2)
SELECT book, 'family' AS kind, name, body FROM o WHERE (book, name) NOT IN (SELECT book, name FROM n) UNION ALL SELECT book, 'family', name, body FROM n
UNION ALL SELECT book, 'note', CAST(min(CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END) AS VARCHAR), size FROM (SELECT manufacturer AS book, size, id FROM L_price WHERE id % 2 = 0 OR id % 3 = 0) GROUP BY book, size""")
def u8(t):
    def guide(where, tag):
        fam = t.L_price.filter(where).groupBy(F.col("manufacturer").alias("book"), F.col("finish").alias("name")).agg(F.concat(F.lit(tag), F.min("id")).alias("body"))
        note = t.L_price.filter(where).selectExpr("manufacturer AS book", "'note' AS kind", "id AS pos", "'' AS name", "size AS body")
        return fam.selectExpr("book", "'family' AS kind", "0L AS pos", "name", "body").unionByName(note)
    fam, notes = bk.merge_guides(guide("id % 2 = 0", "old"), guide("id % 3 = 0", "new"))
    return fam.select("book", F.lit("family").alias("kind"), "name", "body").unionByName(notes.select("book", F.lit("note").alias("kind"), F.col("load").cast("string").alias("name"), "body"))


@query("U7", """
WITH RECURSIVE p AS (SELECT manufacturer AS maker, model AS product, partkey % 50 + 1 AS page, min(partkey) AS pos FROM L_items GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY pos, product) AS i FROM (SELECT maker, product, min(pos) AS pos, list(DISTINCT page) AS pages FROM p GROUP BY 1, 2)),
f AS (SELECT maker, CAST(0 AS BIGINT) AS i, [{'pages': [CAST(-1 AS BIGINT)], 'n': CAST(99 AS BIGINT), 'head': ''}] AS b, '' AS product, CAST(0 AS BIGINT) AS h FROM (SELECT DISTINCT maker FROM o)
  UNION ALL SELECT maker, i, CASE WHEN h IS NULL THEN list_append(b, {'pages': pages, 'n': CAST(1 AS BIGINT), 'head': product})
      ELSE list_transform(b, lambda x, j: CASE WHEN j = h THEN {'pages': list_distinct(list_concat(x.pages, pages)), 'n': x.n + 1, 'head': x.head} ELSE x END) END, product, coalesce(h, len(b) + 1)
  FROM (SELECT f.maker, o.i, f.b, o.product, o.pages, CAST(list_position(list_transform(f.b, lambda x: len(list_intersect(x.pages, o.pages)) > 0 AND x.n < 15 AND len(list_distinct(list_concat(x.pages, o.pages))) <= 4), true) AS BIGINT) AS h
        FROM f JOIN o ON o.maker = f.maker AND o.i = f.i + 1))
SELECT maker, product, b[h].head AS head FROM f WHERE i > 0""")
def u7(t):
    found = t.L_items.selectExpr("manufacturer AS maker", "model AS product", "partkey % 50 + 1 AS page", "partkey AS pos").groupBy("maker", "product", "page").agg(F.min("pos").alias("pos"))
    calls = bk.plan_calls(found).join(found.groupBy("maker", "product").agg(F.min("pos").alias("pos")), ["maker", "product"])
    heads = calls.groupBy("maker", "piece", "batch").agg(F.min_by("product", F.struct("pos", "product")).alias("head"))
    return calls.join(heads, ["maker", "piece", "batch"]).select("maker", "product", "head")


_LAY = """SELECT pdf_page, id, ['626', '630', '689'][CAST(j + 1 AS INT)] AS finish, list_price + j AS list_price FROM L_price, (SELECT unnest([0, 1, 2]) AS j) WHERE pdf_page % 3 = 0 AND NOT (j = 2 AND id % 4 = 0)"""


def _piece(y, x, s, width=20.0):
    return F.struct(y.cast("double").alias("yc"), F.lit(x).cast("double").alias("x0"), F.lit(x + width).cast("double").alias("x1"), s.alias("text"))


def _printed(rows, pieces):
    return rows.select("pdf_page", F.explode(F.array(*pieces)).alias("p")).select("pdf_page", "p.*").filter("text IS NOT NULL")


def _tops(rows):
    return rows.groupBy("pdf_page").agg(F.min("y").alias("y"))


def finish_pages(price):
    """Price rows drawn as a page: an anchor line, a line of finishes, then one line per row."""
    row = price.withColumn("y", 100 + F.col("id") * 12)
    y, money = F.col("y"), lambda j: F.concat(F.lit("$"), F.format_number(F.col("list_price") + j, 2))
    body = _printed(row, [_piece(y, 40, F.concat(F.lit("[98/99]"), "id")), _piece(y, 90, F.lit(".")), _piece(y, 100, F.lit("L")), _piece(y, 300, money(0)), _piece(y, 360, money(1)),
                          _piece(y, 420, F.when(F.col("id") % 4 != 0, money(2)))])
    return body.unionByName(_printed(_tops(row), [_piece(y - 30, 200, F.lit("PRICE BASED ON FINISH")), *[_piece(y - 20, x, F.lit(f)) for x, f in ((302, "626"), (362, "630"), (422, "689"))]]))


def grid_pages(price):
    """Each price row as a product of two sizes, each with three finishes; some blocks print two sizes, some sizes lack a finish."""
    row = price.withColumn("y", 100 + F.col("id") * 96)
    y, i, of = F.col("y"), F.col("id"), lambda j: F.col("list_price") + j
    money = lambda j: of(j).cast("decimal(12,2)").cast("string")
    lines = []
    for block, size in enumerate(('4-1/2" x 5"', "4-1/2 x 6")):
        at = y + 36 * block
        for k, fin in enumerate(("LS", "US10A (US11)", "US26D")):
            shown = F.lit(True) if (block, k) != (1, 2) else i % 4 != 0
            lines += [_piece(at + 12 * k, 300, F.when(shown, F.lit(fin)), 30), _piece(at + 12 * k, 380, F.when(shown, money(5 * block + k)), 30)]
        lines += [_piece(at + 12, 200, F.lit(size), 50), _piece(at, 440, F.when(i % 2 == 0, F.lit("3")))]
    lines += [_piece(y, 40, F.concat(F.lit("BB"), "id"), 30), _piece(y, 90, F.lit("Wide Throw"), 50), _piece(y + 48 + 5, 200, F.when(i % 9 == 0, F.lit('5"')))]
    return _printed(row, lines).unionByName(_printed(_tops(row), [_piece(y - 20, x, F.lit(h), 30) for x, h in ((40, "Description"), (200, "Size"), (300, "Finish"), (380, "List"), (440, "Box"))]))


def row_pages(price):
    """Each price row as a family of sizes under one heading row; some print their code beside the middle of its lines, some none."""
    row = price.withColumn("y", 100 + F.col("id") * 72)
    y, i = F.col("y"), F.col("id")
    money = lambda j: (F.col("list_price") + j).cast("decimal(12,2)").cast("string")
    line = lambda at, size, j, when=F.lit(True): [_piece(at, 120, F.when(when, F.lit(size)))] + [_piece(at, x, F.when(when, money(j + k)), 30) for k, x in enumerate((305, 362, 422))]
    lines = [_piece(y, 40, F.concat(F.lit("AP"), "id"), 30), *line(y, '12"', 0), *line(y + 12, '18"', 5)]
    lines += [*line(y + 24, '12"', 10, i % 3 != 1), *line(y + 36, '18"', 15, i % 3 == 0), _piece(y + 30, 40, F.when(i % 3 == 0, F.concat(F.lit("XT"), "id")), 30)]
    return _printed(row, lines).unionByName(_printed(_tops(row), [
        _piece(y - 20, 40, F.lit("Family"), 30), _piece(y - 20, 120, F.lit("OA Size"), 30), _piece(y - 20, 300, F.lit("605/606"), 40), _piece(y - 20, 360, F.lit("609"), 30), _piece(y - 20, 420, F.lit("List"), 30)]))


@query("X21", f"""WITH l AS ({_LAY}), p AS (SELECT *, CAST(list_price AS DOUBLE) AS price FROM L_price),
c AS (SELECT pdf_page, unnest(['98' || id || 'L', '99' || id || 'L']) AS model, finish, '' AS size, CAST(list_price AS DOUBLE) AS list_price FROM l),
g AS (SELECT pdf_page, 'BB' || id AS model, ['LS', 'US10A', 'US26D'][k + 1] AS finish, ['4-1/2" x 5"', '4-1/2" x 6"'][b + 1] AS size, price + 5 * b + k AS list_price
  FROM p, (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1, 2]) AS k) WHERE pdf_page % 3 = 1 AND NOT (b = 1 AND (id % 9 = 0 OR (k = 2 AND id % 4 = 0)))),
n AS (SELECT id, pdf_page, price, CASE WHEN j < 2 THEN 'AP' ELSE 'XT' END || id AS model, CASE WHEN j % 2 = 0 THEN '12"' ELSE '18"' END AS size, 5 * j AS more FROM p, (SELECT unnest([0, 1, 2, 3]) AS j) WHERE pdf_page % 3 = 2 AND (j < 2 OR id % 3 = 0)),
r AS (SELECT pdf_page, model, f.f AS finish, size, price + more + f.k AS list_price FROM n, (SELECT unnest(['605', '606', '609', '']) AS f, unnest([0, 0, 1, 2]) AS k) f)
SELECT 'finish_columns' AS reader, * FROM c UNION ALL SELECT 'size_finish_grid', * FROM g UNION ALL SELECT 'table_rows', * FROM r""")
def x21(t):
    drawn = [d.withColumn("book", F.lit(f"b{k}")) for k, d in enumerate(draw(t.L_price.filter(F.col("pdf_page") % 3 == k)) for k, draw in enumerate((finish_pages, grid_pages, row_pages)))]
    registry = t.spark.createDataFrame([("b0", ["finish_columns", "table_rows"]), ("b1", ["size_finish_grid", "table_rows"]), ("b2", ["size_finish_grid", "table_rows"])], "book string, readers array<string>")
    rows, _ = pt.read_prices(drawn[0].unionByName(drawn[1]).unionByName(drawn[2]), registry)
    return rows.select("reader", "pdf_page", "model", "finish", "size", F.col("list_price").cast("double").alias("list_price"))
