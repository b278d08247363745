"""Scalar functions over the driver tables. Where DuckDB's patterns lack
look-around, the twin works the expected value out from the numbers the text was made of."""

from pyspark.sql import functions as F

from mullion.functions import sizes, text, vocab
from mullion.lenses import HEADINGS, pick
from mullion.operators import fonts, tables
from mullion.registry import query

KEYS = ["k1", "k2", "k3", "k4"]
K = "k1, k2, k3, k4"


def q(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def says(col, words):
    """DuckDB: whole word or plural, with the boundary consumed."""
    import re
    return f"regexp_matches({col}, '(^|[^A-Z])({'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in words)})S?($|[^A-Z])')"


@query("F1", """SELECT p_partkey, regexp_replace(upper(p_name || '/' || p_type || ' ' || p_size), '[^A-Z0-9]', '', 'g') AS key FROM part""")
def f1(t):
    return t.part.select("p_partkey", text.match_key(F.concat_ws("", "p_name", F.lit("/"), "p_type", F.lit(" "), "p_size")).alias("key"))


_NORM = "trim(regexp_replace(regexp_replace({u}, '[^A-Z0-9# ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("F2", f"""
WITH n AS (SELECT doc, page, line, {_NORM.format(u="upper(replace(text, 'ß', 'ss'))")} AS norm FROM L_line)
SELECT doc, page, line, norm, replace(norm, ' ', '') AS squeezed,
  array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR w[i] <> w[i - 1]), lambda i: w[i]), ' ') AS plain
FROM (SELECT *, list_filter(string_split(norm, ' '), lambda x: x NOT IN ({q(vocab.GROUP_WORDS)})) AS w FROM n)""")
def f2(t):
    norm = t.L_line.select("doc", "page", "line", text.norm_header(F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))).alias("norm"))
    return norm.select("*", text.squeezed(F.col("norm")).alias("squeezed"), text.without_group(F.col("norm")).alias("plain"))


@query("F4", """
SELECT doc, page, line, w, CASE WHEN k <> '' THEN k ELSE 'column_' || (w + 1) END AS key
FROM (SELECT doc, page, line, w, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM L_tok)""")
def f4(t):
    return t.L_tok.select("doc", "page", "line", "w", text.extra_key(F.col("text"), F.col("w")).alias("key"))


_FEET_TEXT = ["concat(CASE WHEN c = 0 THEN '(2)' ELSE '' END, floor(a / 8) + 1, ''' - ', b, CASE WHEN b % 2 = 1 THEN ' 1/2' ELSE '' END, '\"')"]


@query("F7", f"""
SELECT {K}, CASE WHEN v > 0 AND v <= 20 THEN round(v, 6) END AS feet FROM (
  SELECT *, ((a // 8 + 1) + b / 12.0 + CASE WHEN b % 2 = 1 THEN 0.5 / 12 ELSE 0 END) * CASE WHEN c = 0 THEN 2 ELSE 1 END
            + CASE WHEN k2 % 7 = 0 THEN 30 ELSE 0 END AS v FROM L_size)""")
def f7(t):
    s = t.L_size.selectExpr(*KEYS, "concat(CASE WHEN c = 0 THEN '(2)' ELSE '' END, "
                            "CAST(a DIV 8 + 1 + CASE WHEN k2 % 7 = 0 THEN IF(c = 0, 15, 30) ELSE 0 END AS STRING), ''' - ', CAST(b AS STRING), "
                            "CASE WHEN b % 2 = 1 THEN ' 1/2' ELSE '' END, '\"') AS s")
    return s.select(*KEYS, F.round(sizes.parse_feet(F.col("s")), 6).alias("feet"))


def duck_feet(mm):
    """DuckDB: millimetres as feet and inches to the nearest eighth."""
    e = f"CAST(round_even(CAST({mm} AS DOUBLE) / 25.4 * 8, 0) AS BIGINT)"
    frac = (f"CASE {e} % 8 WHEN 0 THEN '' WHEN 4 THEN ' 1/2' WHEN 2 THEN ' 1/4' WHEN 6 THEN ' 3/4' ELSE ' ' || ({e} % 8) || '/8' END")
    return (f"CASE WHEN {e} // 8 < 12 THEN ({e} // 8) || {frac} || '\"' "
            f"ELSE ({e} // 8 // 12) || ''' - ' || ({e} // 8 % 12) || {frac} || '\"' END")


@query("F8", f"""
SELECT {K}, CASE c WHEN 0 THEN '(2)' || {duck_feet('k2 + 20')} WHEN 1 THEN {duck_feet('a * 10')}
       WHEN 2 THEN NULL ELSE {duck_feet('k2 + 20')} END AS size FROM L_size""")
def f8(t):
    s = t.L_size.selectExpr(*KEYS, "CASE c WHEN 0 THEN concat('(2) ', k2 + 20, ' mm') WHEN 1 THEN concat(a, 'cm.') "
                            "WHEN 2 THEN concat('SEE DETAIL ', a, ' mm') ELSE concat(k2 + 20, 'MM') END AS s")
    return s.select(*KEYS, sizes.to_feet_inches(F.col("s")).alias("size"))


@query("F9", f"""
SELECT {K}, CASE WHEN c < 3 AND k2 + 150 BETWEEN 300 AND 9999 THEN {duck_feet('k2 + 150')} END AS size FROM L_size""")
def f9(t):
    s = t.L_size.selectExpr(*KEYS, "concat(k2 + 150, CASE c WHEN 0 THEN '' WHEN 1 THEN 'W' WHEN 2 THEN ' h' ELSE ' each' END) AS s")
    return s.select(*KEYS, sizes.bare_mm(F.col("s")).alias("size"))


@query("F10", f"""
SELECT {K}, (n // 12) || ''' - ' || (n % 12) || '"' AS size FROM (SELECT *, CAST(round_even(a / 7.0 * 12, 0) AS BIGINT) AS n FROM L_size)""")
def f10(t):
    return t.L_size.select(*KEYS, sizes.feet_inches(F.col("a") / F.lit(7.0)).alias("size"))


@query("F11", f"""
SELECT {K}, CAST(a + b / 16.0 AS DOUBLE) AS inches, CASE WHEN c = 3 THEN NULL ELSE CAST(a + 0.5 AS DOUBLE) END AS high,
       CASE WHEN c IN (0, 1) THEN CAST(b + 1 AS DOUBLE) END AS wide,
       CASE c WHEN 0 THEN b || '''' WHEN 1 THEN b || '''' WHEN 2 THEN CASE WHEN a >= 10 AND a % 12 = 0 THEN (a // 12) || '''' END END AS device,
       CASE WHEN c < 2 THEN 'AB' ELSE 'AB 9' END AS stripped
FROM L_size""")
def f11(t):
    s = t.L_size.selectExpr(
        *KEYS, "c", "concat(a, '-', b, '/16') AS i",
        "CASE c WHEN 0 THEN concat(a, '½ x ', b + 1) WHEN 1 THEN concat(a, ' 1/2\" X ', b + 1, '\"') WHEN 2 THEN concat(a, '-1/2\"') ELSE 'NONE' END AS d",
        "CASE c WHEN 0 THEN concat(b, '\\'-0\"') WHEN 1 THEN concat(b, '\\'') WHEN 2 THEN concat(a, '\"') ELSE concat(b, '\\'-6\"') END AS l",
        "concat('AB ', CASE c WHEN 0 THEN concat(a, ' x ', b) WHEN 1 THEN concat(b, '\\'') ELSE '9' END) AS z")
    dims = sizes.dimensions(F.col("d"))
    return s.select(*KEYS, sizes.inches(F.col("i")).alias("inches"), F.get(dims, F.lit(0)).alias("high"),
                    F.get(dims, F.lit(1)).alias("wide"), sizes.device_length(F.col("l")).alias("device"),
                    F.trim(sizes.strip_sizes(F.col("z"))).alias("stripped"))


_PLATE_TEXT = "concat('190S ', a % 20 + 4, '\" x ', k2 % 40 + 1, '\"', IF(k3 % 3 = 0, ' LDW', ''))"
_PLATE_SQL = """CASE WHEN width > 0 AND NOT (k3 % 3 <> 0 AND least(h, width) < 6 AND greatest(h, width) < 12)
     THEN CAST(2 * ((h + 1) // 2) * 2 * ((width + 1) // 2) / 100.0 AS DOUBLE) END"""
_PLATE_FROM = """(SELECT *, CASE WHEN k3 % 3 = 0 THEN 36 - w ELSE w END AS width FROM (SELECT *, a % 20 + 4 AS h, k2 % 40 + 1 AS w FROM L_size))"""


@query("F12", f"SELECT {K}, {_PLATE_SQL} AS units FROM {_PLATE_FROM}")
def f12(t):
    return t.L_size.selectExpr(*KEYS, f"{_PLATE_TEXT} AS s").select(*KEYS, sizes.plate_units(F.col("s"), F.lit(36.0)).alias("units"))


_LENGTH_TEXT = ("CASE k4 % 5 WHEN 0 THEN concat('726 x LAR - ', a, '\\'') WHEN 1 THEN concat('488S @ HEAD [', a, ' LF]') "
                "WHEN 2 THEN concat('425 x ', k2 % 40 + 1, ' in') WHEN 3 THEN concat('160SA x 36 x ', 60 + b * 2, ' in') ELSE '413S x LAR' END")


@query("F13", f"""
SELECT {K}, CASE WHEN v = floor(v) THEN CAST(v AS DOUBLE) END AS feet FROM (
  SELECT *, CASE k4 % 5 WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN (k2 % 40 + 1) / 12.0 WHEN 3 THEN (36 + 2 * (60 + b * 2)) / 12.0
            ELSE (30 + k3 % 3 * 6) / 12.0 END AS v FROM L_size)""")
def f13(t):
    return t.L_size.selectExpr(*KEYS, f"{_LENGTH_TEXT} AS s", "CAST(30 + k3 % 3 * 6 AS DOUBLE) AS w").select(
        *KEYS, sizes.length_units(F.col("s"), F.col("w")).alias("feet"))


_PER = ["per foot", "per 100 sq. in.", "each", "per sq ft", "LF", "pair", "hundred square inches"]


@query("F14", f"""
SELECT {K}, ['length','area','each','area','length','each','area'][CAST(k1 % 7 AS INT) + 1] AS kind,
       CASE WHEN k1 % 7 IN (1, 6) THEN {_PLATE_SQL} END AS units FROM {_PLATE_FROM}""")
def f14(t):
    s = t.L_size.selectExpr(*KEYS, f"{pick(_PER, 'k1 % 7', 'spark')} AS per", f"{_PLATE_TEXT} AS s")
    per = F.col("per")
    return s.select(*KEYS, sizes.rate_kind(per).alias("kind"),
                    F.when(sizes.is_area(per), sizes.expected_units(per, F.col("s"), F.lit(36.0))).alias("units"))


@query("F15", f"""
SELECT {K}, CASE c WHEN 0 THEN CAST(a AS DOUBLE) WHEN 1 THEN CAST(a AS DOUBLE) WHEN 2 THEN CAST(b * 12 + 6 AS DOUBLE) END AS width FROM L_size""")
def f15(t):
    s = t.L_size.selectExpr(*KEYS, "CASE c WHEN 0 THEN CAST(a AS STRING) WHEN 1 THEN concat(a, ' in') WHEN 2 THEN concat(b, '\\'-6\"') ELSE '' END AS s")
    return s.select(*KEYS, sizes.door_width(F.col("s")).alias("width"))


@query("F16", f"""
SELECT {K}, unnest(CASE c WHEN 0 THEN ['9' || a || 'NL', '8' || a || 'NL'] WHEN 1 THEN ['XP' || a] WHEN 2 THEN ['E-' || a, 'E-' || (a + 1), 'E-' || (a + 2)]
       ELSE [] END) AS model FROM L_size""")
def f16(t):
    s = t.L_size.selectExpr(*KEYS, "CASE c WHEN 0 THEN concat('[9', a, '/8', a, ']NL') WHEN 1 THEN concat('XP', a) "
                            "WHEN 2 THEN concat('E-[', a, '/', a + 1, '/', a + 2, ']') ELSE concat('no ', a) END AS s")
    return s.select(*KEYS, F.explode(text.expand_product(F.col("s"))).alias("model"))


_TAG_SQL = "(regexp_matches({c}, '^[A-Za-z0-9]{{1,6}}([-.][A-Za-z0-9]{{1,4}})?$') AND regexp_matches({c}, '[0-9]'))"


@query("F17", f"""SELECT doc, page, line, w, text, {_TAG_SQL.format(c='text')} AS is_tag FROM L_plan""")
def f17(t):
    return t.L_plan.select("doc", "page", "line", "w", "text", text.is_tag(F.col("text")).alias("is_tag"))


@query("F18", f"""
SELECT {K}, CASE c WHEN 0 THEN a || 'B' WHEN 1 THEN CAST(100 + a AS VARCHAR) WHEN 2 THEN CAST(a AS VARCHAR) ELSE 'STAIR ' || a END AS tag,
       CASE c WHEN 1 THEN 'ALTERATION ROOM ' || b WHEN 2 THEN 'HMX1' ELSE '' END AS room FROM L_size""")
def f18(t):
    s = t.L_size.selectExpr(*KEYS, "CASE c WHEN 0 THEN concat(a, ' B') WHEN 1 THEN concat(100 + a, ' ALTERATION ROOM ', b) "
                            "WHEN 2 THEN concat(a, ' HMX1') ELSE concat('STAIR ', a) END AS s", "c")
    out = s.select(*KEYS, "c", "s", text.clean_tag(F.col("s")).alias("r"))
    return out.select(*KEYS, F.col("r.tag").alias("tag"), F.col("r.room").alias("room"))


@query("F19", f"""
SELECT {K}, unnest(CASE c WHEN 0 THEN [CAST(a AS VARCHAR), CAST(a + 1 AS VARCHAR), CAST(a + 2 AS VARCHAR)]
   WHEN 1 THEN [a || 'A', b || 'B'] WHEN 2 THEN [a || ' B'] ELSE ['STAIR ' || a] END) AS tag FROM L_size""")
def f19(t):
    s = t.L_size.selectExpr(*KEYS, "CASE c WHEN 0 THEN concat(a, ',', a + 1, ' ', a + 2, ',') WHEN 1 THEN concat(a, 'A & ', b, 'B') "
                            "WHEN 2 THEN concat(a, ' B') ELSE concat('STAIR ', a) END AS s")
    tags = text.listed_tags(F.col("s"))
    return s.select(*KEYS, F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array("s"))).alias("tag"))


@query("F21", """
SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS amount, p_partkey % 3 <> 2 AS is_price FROM part""")
def f21(t):
    n = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"
    s = t.part.selectExpr("p_partkey", f"CASE p_partkey % 3 WHEN 0 THEN concat('$', format_number(p_retailprice, 2)) "
                          f"WHEN 1 THEN {n} ELSE concat('$ ', {n}) END AS s")
    return s.select("p_partkey", text.amount(F.trim(F.replace("s", F.lit("$ "), F.lit("")))).cast("double").alias("amount"),
                    text.is_price(F.col("s")).alias("is_price"))


@query("F22", r"""
SELECT doc, page, line, trim(regexp_replace(regexp_replace(translate(text, '‑‐–”″’', '---""'''), '[\x00-\x1f\x7f]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS text
FROM L_line""")
def f22(t):
    return t.L_line.select("doc", "page", "line", text.clean(F.col("text")).alias("text"))


@query("F23", """
WITH moved AS (SELECT doc_id, lang, original, array_to_string(list_transform(string_split(original, ''), lambda c: chr(CAST(unicode(c) - 29 AS INT))), '') AS text
  FROM (SELECT doc_id, lang, regexp_replace(text, '[\\x00-\\x1f]', ' ', 'g') AS original FROM documents) WHERE original <> ''),
chars AS (SELECT lang, unicode(c) - 29 AS u, count(*) AS n FROM (SELECT lang, unnest(string_split(original, '')) AS c FROM moved)
          WHERE NOT (u IN (9, 10, 13, 32, 133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202) GROUP BY ALL),
ok AS (SELECT unicode(c) AS u FROM (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,-/''"#&():;%+*=', '')) AS c)),
share AS (SELECT lang, s, sum(n) FILTER (WHERE u + s IN (SELECT u FROM ok)) AS good, sum(n) AS total FROM chars, range(1, 96) r(s) GROUP BY ALL),
f AS (SELECT lang, CAST(arg_max(s, coalesce(good, 0) * 1000 - s) AS BIGINT) AS shift, CAST(max(coalesce(good, 0)) AS BIGINT) AS readable, CAST(max(total) AS BIGINT) AS total
FROM share GROUP BY lang HAVING max(good) >= 0.9 * max(total)),
r AS (SELECT doc_id, m.lang, shift, readable, total, original, CASE WHEN shift IS NOT NULL AND regexp_matches(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]')
  THEN array_to_string(list_transform(string_split(text, ''), lambda c: chr(CAST(unicode(c) + shift AS INT))), '') ELSE text END AS text FROM moved m LEFT JOIN f USING (lang))
SELECT doc_id, lang, shift, readable, total, md5(text) AS repaired, text = original AS restored FROM r""")
def f23(t):
    # Each language is a font whose glyph numbers lie 29 below the letters they draw.
    d = t.documents.select("doc_id", "lang", F.regexp_replace("text", r"[\x00-\x1f]", " ").alias("original")).filter("original <> ''")
    moved = d.withColumn("text", fonts.drawn_below("original", 29))
    back = fonts.repair(moved, ["lang"]).select("doc_id", "lang", F.md5("text").alias("repaired"), (F.col("text") == F.col("original")).alias("restored"))
    return back.join(fonts.shifts(moved, ["lang"]), "lang", "left").select("doc_id", "lang", "shift", "readable", "total", "repaired", "restored")


@query("F24", r"""
SELECT book, page, line, CAST(count(DISTINCT v) AS BIGINT) AS n, CAST(sum(DISTINCT v) AS DOUBLE) AS total FROM (
  SELECT book, page, line, unnest(list_concat(
    list_transform(regexp_extract_all(text, '\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$?\d+(?:\.\d+)?'), lambda x: TRY_CAST(replace(replace(x, '$', ''), ',', '') AS DECIMAL(18,2))),
    list_transform(regexp_extract_all(text, '(?:^|[^\w.])-\$(\d{1,3}(?:,\d{3})*(?:\.\d+)?)', 1), lambda x: -TRY_CAST(replace(x, ',', '') AS DECIMAL(18,2))))) AS v
  FROM L_book) WHERE v IS NOT NULL GROUP BY ALL""")
def f24(t):
    return (t.L_book.select("book", "page", "line", F.explode(F.array_distinct(text.amounts(F.col("text")))).alias("v"))
            .groupBy("book", "page", "line").agg(F.count("v").alias("n"), F.sum("v").cast("double").alias("total")))


_TOKENS = ["626", "US26D", "26D", "4050AT-3038H", "12\"", "4-1/2\" x 5\"", "3'", "$1,061.30", "1061.30", "Powder", "652", "01/02/2026", "AP751", "LS", "9x"]
_KINDS = ["finish", "finish", "finish", "code", "size", "size", "size", "price", "price", "word", "finish", "word", "code", "finish", "word"]


@query("F25", f"""
SELECT {K}, {pick(_TOKENS, '(k2 + k3) % 15', 'duckdb')} AS token, {pick(_KINDS, '(k2 + k3) % 15', 'duckdb')} AS kind FROM L_size""")
def f25(t):
    return t.L_size.selectExpr(*KEYS, f"{pick(_TOKENS, '(k2 + k3) % 15', 'spark')} AS token").withColumn(
        "kind", text.token_kind(F.col("token")))


@query("F26", "SELECT id, upper(regexp_replace(number, '[-. ]', '', 'g')) AS number FROM L_title")
def f26(t):
    return t.L_title.select("id", text.norm_number(F.col("number")).alias("number"))


@query("F27", """
WITH keys AS (SELECT DISTINCT manufacturer, match_key FROM L_price),
want AS (SELECT DISTINCT manufacturer, match_key || '1' AS want FROM L_price WHERE kind = 'size_add'),
pair AS (SELECT w.manufacturer, want, match_key, 1 - levenshtein(want, match_key) / CAST(greatest(length(want), length(match_key)) AS DOUBLE) AS s
         FROM want w JOIN keys k ON k.manufacturer = w.manufacturer AND left(want, 3) = left(match_key, 3))
SELECT manufacturer, want, match_key, round(s, 6) AS s FROM pair WHERE s >= 0.6 - 1e-9
QUALIFY row_number() OVER (PARTITION BY manufacturer, want ORDER BY s DESC, match_key) <= 5""")
def f27(t):
    from mullion.operators import prices
    want = t.L_price.filter("kind = 'size_add'").select("manufacturer", F.concat("match_key", F.lit("1")).alias("want")).distinct()
    return prices.closest(want, t.L_price.select("manufacturer", "match_key").distinct(), k=5, cutoff=0.6).select(
        "manufacturer", "want", "match_key", F.round("s", 6).alias("s"))


@query("F28", """
SELECT event_id, CAST(2 AS BIGINT) AS n, CAST(2 * CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS BIGINT) AS total, event_id % 4 = 0 AS truncated FROM events""")
def f28(t):
    from mullion.operators import replies
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    s = t.events.selectExpr("event_id", f"concat('[{{\"k\": ', {k}, '}}, {{\"k\": ', {k} + 1, '}}', IF(event_id % 4 = 0, ', {{\"k\"', ']')) AS reply".replace("{{", "{").replace("}}", "}"))
    return replies.read_objects(s, "reply", "k bigint").select(
        "event_id", F.size("objects").cast("bigint").alias("n"),
        F.expr("aggregate(objects, 0L, (a, o) -> a + o.k)").alias("total"), "truncated")


@query("F29", """
SELECT source, sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, sha""")
def f29(t):
    return (t.documents.select("source", "doc_id", text.digest(F.col("text")).alias("sha")).groupBy("source", "sha")
            .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))


@query("F32", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN CAST(page_id % 1000 AS VARCHAR) WHEN 1 THEN CAST(page_id % 1000 AS VARCHAR)
       WHEN 2 THEN CAST(page_id % 1000 AS VARCHAR) ELSE '' END AS printed FROM pages""")
def f32(t):
    s = t.pages.selectExpr("page_id", "concat(CASE page_id % 4 WHEN 0 THEN concat(page_id % 1000, '  Price book 16\\n') "
                           "WHEN 1 THEN concat('Von - Rev. 10/26  ', page_id % 1000, '\\n') WHEN 2 THEN concat('Head\\n', page_id % 1000, '\\n03/01/2026\\n') "
                           "ELSE '' END, regexp_replace(html, '<[^>]*>|[0-9]', ' ')) AS s")
    return s.select("page_id", text.printed_page(F.col("s")).alias("printed"))


_FIN = ["626", "US26D", "689", "SPBLK", "612E", "Brass", "List", "605"]


@query("F33", f"""
SELECT {K}, CASE WHEN k2 % 8 IN (5, 6) OR k3 % 8 IN (5, 6) THEN '' ELSE {pick([f.upper() for f in _FIN], 'k2 % 8', 'duckdb')} || ',' || {pick([f.upper() for f in _FIN], 'k3 % 8', 'duckdb')} END AS finishes
FROM L_size""")
def f33(t):
    s = t.L_size.selectExpr(*KEYS, f"concat({pick(_FIN, 'k2 % 8', 'spark')}, IF(a % 2 = 0, ' or ', '/'), {pick(_FIN, 'k3 % 8', 'spark')}) AS s")
    return s.select(*KEYS, F.array_join(text.finishes_in(F.col("s")), ",").alias("finishes"))


# Titles -------------------------------------------------------------------

@query("P11", f"SELECT id, title, {says('title', ['SITE'])} AS site, {says('title', ['PLAN'])} AS plan, {says('title', ['LEVEL'])} AS level FROM L_title")
def p11(t):
    c = F.col("title")
    return t.L_title.select("id", "title", text.says(c, ["SITE"]).alias("site"), text.says(c, ["PLAN"]).alias("plan"),
                            text.says(c, ["LEVEL"]).alias("level"))


_ARCH = """(regexp_extract(number, '^[A-Z]+', 0) <> 'AV' AND (left(regexp_extract(number, '^[A-Z]+', 0), 1) IN ('A', 'I')
           OR regexp_extract(number, '^[A-Z]+', 0) = 'CR'))"""


@query("P12", f"SELECT id, regexp_extract(number, '^[A-Z]+', 0) AS discipline, {_ARCH} AS architectural FROM L_title")
def p12(t):
    return t.L_title.select("id", text.discipline(F.col("number")).alias("discipline"), text.is_architectural(F.col("number")).alias("architectural"))


_FLOOR = f"({says('title', vocab.IS_THE_FLOOR)} OR regexp_matches(title, '(^|[^A-Z])FLOOR\\s*(&|\\+|/|AND)'))"
_PLAN = r"regexp_matches(title, '\bPLANS?\b')"


@query("P13", f"""
SELECT id, title, {_PLAN} AND NOT {says('title', [w for w in vocab.NOT_A_FLOOR_PLAN if w not in vocab.SHARES_THE_SHEET])}
       AND ({_FLOOR} OR NOT {says('title', vocab.SHARES_THE_SHEET)}) AND NOT {says('title', vocab.ONE_PART_OF_IT)}
       AND ({_FLOOR} OR NOT {says('title', vocab.ANOTHER_SUBJECT)}) AS floor_plan FROM L_title""")
def p13(t):
    return t.L_title.select("id", "title", text.is_floor_plan(F.col("title")).alias("floor_plan"))


_NOT_A_PLAN = f"""{says('title', vocab.INDEX_TITLES)} OR ({_PLAN} AND NOT {_FLOOR} AND {says('title', vocab.ANOTHER_SUBJECT)})
       OR ({says('title', vocab.OTHER_PROJECTION)} AND NOT {_PLAN}) OR ({says('title', vocab.CEILING_TITLES)} AND NOT {_FLOOR})"""


@query("P14", f"""
SELECT id, {_NOT_A_PLAN} AS not_a_plan,
       (title LIKE '%ENLARGED%' OR title LIKE '%ENL. PLAN%' OR title LIKE '%UNIT PLAN%') AND title NOT LIKE '%FLOOR PLAN%' AS enlargement
FROM L_title""")
def p14(t):
    return t.L_title.select("id", text.not_a_plan(F.col("title")).alias("not_a_plan"), text.is_enlargement(F.col("title")).alias("enlargement"))


@query("P15", """
SELECT id, CASE id % 10 WHEN 0 THEN 'LEVEL 1' WHEN 1 THEN 'LEVEL 2' WHEN 2 THEN 'LEVEL 1' WHEN 3 THEN 'BASEMENT' WHEN 4 THEN 'MEZZANINE'
       WHEN 6 THEN 'GROUND' WHEN 8 THEN 'PHASE II' WHEN 9 THEN 'MEZZANINE' ELSE '' END AS level FROM L_title""")
def p15(t):
    return t.L_title.select("id", text.level_of(F.col("title")).alias("level"))


_OTHER = f"""(NOT ({' OR '.join(f"title LIKE '%{w}%'" for w in vocab.DOOR_WORDS)}) AND ({' OR '.join(f"title LIKE '%{w}%'" for w in vocab.OTHER_SCHEDULES)}))"""


@query("P16", f"""
SELECT id, CASE WHEN title LIKE '%SCHEDULE%' AND (title LIKE '%DOOR%' OR title LIKE '%OPENING%') THEN 'named'
     WHEN title LIKE '%SCHEDULE%' AND NOT {_OTHER} AND {_ARCH} THEN 'schedules' END AS level FROM L_title""")
def p16(t):
    return t.L_title.select("id", text.door_sheet_level(F.col("number"), F.col("title")).alias("level"))


@query("P17", f"""
SELECT id, {_OTHER} AS other_schedule, len(list_intersect(string_split({_NORM.format(u="heading")}, ' '), [{q(vocab.FOREIGN_COLUMNS)}])) > 0 AS another_trade
FROM (SELECT *, {pick(HEADINGS, 'id * 3 % 20', 'duckdb')} AS heading FROM L_title)""")
def p17(t):
    s = t.L_title.selectExpr("id", "title", f"{pick(HEADINGS, 'id * 3 % 20', 'spark')} AS heading")
    return s.select("id", text.is_other_schedule(F.col("title")).alias("other_schedule"), text.names_another_trade(F.col("heading")).alias("another_trade"))


def header_rows(t):
    """Ten headings per order, chosen by its keys."""
    picks = ", ".join(pick(HEADINGS, f"(id * {2 * i + 1} + page + {i}) % 20", "spark") for i in range(10))
    return t.L_title.selectExpr("id", f"array({picks}) AS headers")


_HEADS = ", ".join(pick(HEADINGS, f"(id * {2 * i + 1} + page + {i}) % 20", "duckdb") for i in range(10))
# Expected field of each heading of HEADINGS when it is the first of its kind.
_FIRST = {"DOOR NO.": "door_tag", "WIDTH": "door_width", "HEIGHT": "door_height", "TYPE": "door_type", "MATERIAL": "door_material",
          "FINISH": "door_finish", "FRAME FINISH": "frame_finish", "HARDWARE SET": "hw_set", "REMARKS": "comments",
          "FROM ROOM": "from_space", "TO ROOM": "to_space", "FIRE RATING": "fire_rating", "THRESHOLD": "threshold",
          "FRAME TYPE": "frame_type", "DOOR THK": "door_thickness"}
_FRAME = {"TYPE": "frame_type", "MATERIAL": "frame_material", "FINISH": "frame_finish"}


@query("F3", f"""
WITH h AS (SELECT id, unnest([{_HEADS}]) AS heading, unnest(range(10)) AS i FROM L_title),
n AS (SELECT *, row_number() OVER (PARTITION BY id, heading ORDER BY i) AS nth FROM h),
first AS (SELECT *, CASE WHEN nth = 1 THEN CASE heading {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIRST.items())} END
     END AS field FROM n),
second AS (SELECT *, CASE WHEN nth = 2 THEN CASE heading {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _FRAME.items())} WHEN 'TO ROOM' THEN 'from_space' END END AS handed FROM first)
SELECT s.id, s.i, s.heading, coalesce(s.field, CASE WHEN f.id IS NULL THEN s.handed END, '') AS field
FROM second s LEFT JOIN (SELECT DISTINCT id, field FROM first WHERE field IS NOT NULL) f ON f.id = s.id AND f.field = s.handed""")
def f3(t):
    rows = tables.map_headers(header_rows(t), ["id"])
    return rows.select("id", F.posexplode(F.arrays_zip("headers", "fields")).alias("i", "z")).select(
        "id", F.col("i").cast("bigint").alias("i"), F.col("z.headers").alias("heading"), F.col("z.fields").alias("field"))
