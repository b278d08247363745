"""Price-book maps: furniture, headings, models, indexes, hints and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mullion.functions import text, vocab
from mullion.operators.prices import candidates
from mullion.runtime import cut, small


def printed_in_maps(items: DataFrame, maps: DataFrame) -> DataFrame:
    """Per maker: how many of its models have a candidate printed in its own maps, and in another maker's.

    ``items(manufacturer, model)`` distinct; ``maps(maker, models)``.
    """
    codes = maps.select("maker", F.explode("models").alias("code")).distinct()
    c = items.select("manufacturer", "model", F.explode_outer(candidates(F.col("model"))).alias("code"))
    hit = c.join(codes, "code", "left").groupBy("manufacturer", "model").agg(
        F.max(F.coalesce(F.col("maker") == F.col("manufacturer"), F.lit(False))).alias("own"),
        F.max(F.coalesce(F.col("maker") != F.col("manufacturer"), F.lit(False))).alias("other"))
    return hit.groupBy("manufacturer").agg(F.count(F.lit(1)).alias("models"), F.count(F.when(F.col("own"), 1)).alias("printed"), F.count(F.when(F.col("other"), 1)).alias("elsewhere"))


def furniture(lines: DataFrame, share: float = 0.4, edge_share: float = 0.2, least: int = 4) -> DataFrame:
    """(book, key) of lines a book repeats: on over 40 % of its text pages, or over 20 % at a page edge.

    Digits count as one another. ``lines(book, page, text, edge)``; a line counts once per page.
    """
    key = F.upper(F.regexp_replace("text", r"\d+", "#"))
    once = lines.select("book", "page", key.alias("key"), "edge").groupBy("book", "page", "key").agg(F.max("edge").alias("edge"))
    n = once.groupBy("book", "key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("edge"), 1)).alias("n_edge"))
    pages = lines.select("book", "page").distinct().groupBy("book").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least)
    return n.join(small(pages), "book").filter((F.col("n") > F.col("pages") * share) | (F.col("n_edge") > F.col("pages") * edge_share)).select("book", "key")


def page_map(items: DataFrame, k: int = 25) -> DataFrame:
    """Per page: heading, printed prices and its first ``k`` model codes, priced lines first.

    ``items(book, page, line, w, text, size)``; the heading is the large text in the top of the page,
    else the first line that is not page numbers alone.
    """
    from mullion.operators.ranking import smallest

    keys = ["book", "page"]
    page_no = F.col("text").rlike(r"^\d{1,4}$")
    i = items.withColumn("price", text.is_price(F.col("text")))
    body = i.groupBy(*keys).agg(F.median("size").alias("body"), F.max("line").alias("last"), F.count(F.when(F.col("price"), 1)).alias("prices"))
    j = i.join(body, keys)
    big = j.filter((F.col("line") <= F.col("last") * 0.35) & (F.col("size") >= F.col("body") * 1.15) & ~F.col("price") & ~page_no).withColumn("pref", F.lit(0))
    lead = j.groupBy(*keys, "line").agg(F.min(page_no).alias("_all")).filter("NOT _all").groupBy(*keys).agg(F.min("line").alias("line"))
    first = j.join(lead, [*keys, "line"], "left_semi").filter("NOT price").withColumn("pref", F.lit(1))
    cand = big.unionByName(first)
    pref = cand.groupBy(*keys).agg(F.min("pref").alias("pref"))
    texts = cand.join(pref, [*keys, "pref"]).groupBy(*keys, "text").agg(F.min(F.struct("line", "w")).alias("at"))
    # 150 characters hold at most 150 texts, so no more than that are put together.
    head = smallest(texts, keys, [F.col("at")], 150).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s.text), " - ").alias("h"))
    priced = i.groupBy(*keys, "line").agg(F.max("price").alias("_p"))
    word = F.btrim("text", F.lit("*†,;:()."))
    codes = (i.join(priced, [*keys, "line"]).withColumn("code", word)
             .filter(text.is_code(F.col("code")) & ~F.col("code").rlike(r"^(\d+(-\d+)+|(19|20)\d\d|\d{1,3})$|[a-z]{2,}$"))
             .groupBy(*keys, "code").agg(F.min(F.struct((~F.col("_p")).cast("int").alias("p"), "line", "w")).alias("at")))
    models = smallest(codes, keys, [F.col("at")], k).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda s: s.code).alias("models"))
    return (body.select(*keys, "prices").join(head, keys, "left").join(models, keys, "left")
            .select(*keys, F.btrim(F.substring(F.coalesce("h", F.lit("")), 1, 150), F.lit(" -")).alias("heading"), "prices", F.coalesce("models", F.array().cast("array<string>")).alias("models")))


def index_pages(tokens: DataFrame, pages: DataFrame, least: int = 15) -> DataFrame:
    """(code, printed page) pairs of pages that are an index: ``least`` such neighbours and a Page heading or dot leaders.

    ``tokens(book, page, line, w, text)``, ``pages(book, pages)``.
    """
    from mullion.operators import sequence as seq

    keys = ["book", "page"]
    t = tokens.withColumn("at", F.col("line") * 1_000_000 + F.col("w"))
    d = seq.running(t, keys, F.floor(F.col("line") / 64), ["at"], {"_p": ("last", F.struct("line", "text"))}, inclusive=False)
    n = F.col("text").try_cast("int")
    pairs = (d.filter((F.col("_p.line") == F.col("line")) & F.col("text").rlike(r"^\d{1,4}$") & text.is_code(F.btrim("_p.text", F.lit("*†"))))
             .join(small(pages), "book").filter((n > 0) & (n <= F.col("pages") * 2)).select(*keys, F.btrim("_p.text", F.lit("*†")).alias("model"), F.col("text").alias("printed_page")))
    head = tokens.filter(F.col("text").rlike(r"(?i)^page$") | F.col("text").rlike(r"\.{3,}")).select(*keys).distinct()
    enough = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).join(head, keys, "left_semi")
    return pairs.join(enough.select(*keys), keys, "left_semi")


def effective_date(lines: DataFrame, pages: int = 6) -> DataFrame:
    """Date a book's prices take effect: said in words, else the slash date its first pages carry most often.

    ``lines(book, page, line, text)``.
    """
    from mullion.operators.ranking import smallest

    front = smallest(lines.select("book", "page").distinct(), ["book"], [F.col("page")], pages).select("book", "page")
    f = lines.join(small(front), ["book", "page"], "left_semi")
    months = F.create_map(*[F.lit(x) for i, m in enumerate(vocab.MONTHS) for x in (m, i + 1)])
    part = lambda i: F.regexp_extract("text", vocab.EFFECTIVE_RE, i)
    said = (f.filter(F.col("text").rlike(vocab.EFFECTIVE_RE)).withColumn("d", F.make_date(part(3).cast("int"), F.element_at(months, part(1)), part(2).cast("int")))
            .groupBy("book").agg(F.min_by("d", F.struct("page", "line")).alias("said")))
    slash = f.select("book", "page", "line", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{2}/\d{2}/20\d{2}\b"), F.lit(0))).alias("s"))
    usual = slash.groupBy("book", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line")).alias("at")).groupBy("book").agg(F.min_by("s", F.struct(-F.col("n"), "at", "s")).alias("s"))
    return said.join(usual, "book", "full").select("book", F.coalesce("said", F.try_to_date("s", "MM/dd/yyyy")).alias("effective_date"))


def place(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Index entries with their pdf page, where the printed number occurs once in the book."""
    once = pages.filter("printed_page <> ''").groupBy("book", "printed_page").agg(F.count(F.lit(1)).alias("_n"), F.min("page").alias("pdf_page")).filter("_n = 1").drop("_n")
    return index.join(once, ["book", "printed_page"], "left")


def index_hints(products: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` pages a book's index names for a product, in text order.

    ``products(maker, product, keys)``, ``index(maker, match_key, place)``.
    """
    from mullion.operators.ranking import smallest

    hit = products.select("maker", "product", F.explode("keys").alias("match_key")).join(index, ["maker", "match_key"]).select("maker", "product", "place").distinct()
    return smallest(hit, ["maker", "product"], [F.col("place")], k).groupBy("maker", "product").agg(F.array_sort(F.collect_list("place")).alias("hints"))


def rate_pages(lines: DataFrame) -> DataFrame:
    """Pages priced by measure: this page or the one before says so."""
    said = lines.filter(F.col("text").rlike(vocab.RATE_PAGE_RE)).select("book", F.explode(F.array("page", F.col("page") + 1)).alias("page")).distinct()
    return lines.select("book", "page").distinct().join(said, ["book", "page"], "left_semi")


#: Lines above a price that are looked at first for its heading.
CLOSE = 8


def price_headings(pieces: DataFrame, keys, cell: float = 32.0, also=None, most: int | None = 400) -> DataFrame:
    """Heading of each price: the nearest line above with text spanning its centre, prices' and codes' lines skipped.

    ``pieces(keys, line, w, x0, x1, text)``; pieces for which ``also`` holds get their heading too. Most headings stand a few
    lines above their price, so those are looked at first, by blocks of lines; only prices without one there look farther up,
    ``most`` lines at most. With None a heading may stand any number of lines above (``headings_above``).
    """
    keys = list(keys)
    if most is None:
        return headings_above(pieces, keys, also)
    p = pieces.withColumn("price", text.is_price(F.col("text")))
    held = p.filter(F.col("price") | F.col("text").rlike(r"\$\d") | F.col("text").rlike(r"(?i)\b(no (addition|charge)|n/a)\b")).select(*keys, "line").distinct()
    over = (p.join(held, [*keys, "line"], "left_anti").select(*keys, F.col("line").alias("hl"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("text").alias("ht")))
    over = cut(over).withColumn("_g", F.explode(F.sequence(F.floor((F.col("hx0") - 4) / cell), F.floor((F.col("hx1") + 4) / cell))))
    xc = (F.col("x0") + F.col("x1")) / 2
    prices = p.filter("price" if also is None else F.col("price") | also).select(*keys, "line", "w", xc.alias("xc"), F.floor(xc / cell).alias("_g"))
    prices = cut(prices)

    def nearest(pairs: DataFrame, past: int, most: int) -> DataFrame:
        """Headings that stand more than ``past`` and up to ``most`` lines above."""
        pairs = pairs.filter((F.col("hl") < F.col("line") - past) & (F.col("hl") >= F.col("line") - most) & F.col("xc").between(F.col("hx0") - 4, F.col("hx1") + 4))
        said = pairs.groupBy(*keys, "line", "w", "hl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hx0", "ht"))), lambda s: s.ht), " ").alias("h"))
        codes = (text.is_code(F.col("h")) | F.col("h").rlike(r"^[0-9A-Z]{1,4}[†*]?$")) & ~finish_list(F.col("h"))
        return said.filter(~codes).groupBy(*keys, "line", "w").agg(F.max_by("h", "hl").alias("heading"))

    block = lambda line: F.floor(line / CLOSE)
    blocks = prices.withColumn("_b", F.explode(F.sequence(block(F.col("line") - CLOSE), block(F.col("line")))))
    close = cut(nearest(blocks.join(over.withColumn("_b", block(F.col("hl"))), [*keys, "_g", "_b"]), 0, CLOSE))
    rest = prices.join(close, [*keys, "line", "w"], "left_anti")
    near = close.unionByName(nearest(rest.join(over, [*keys, "_g"]), CLOSE, most))
    return prices.select(*keys, "line", "w").join(near, [*keys, "line", "w"], "left").withColumn("heading", F.coalesce("heading", F.lit("")))


def headings_above(pieces: DataFrame, keys, also=None, cell: float = 64.0) -> DataFrame:
    """``price_headings`` without a limit: a heading is carried down to its prices however far below they stand.

    A page is dealt once and folded in plain windows. Texts meet the centres that the prices of their cell have, so a column of
    prices at one place asks for each line once.
    """
    from mullion.operators import sequence as seq

    keys = list(keys)
    at = [*keys, "line", "w"]
    price = text.is_price(F.col("text"))
    money = price | F.col("text").rlike(r"\$\d") | F.col("text").rlike(r"(?i)\b(no (addition|charge)|n/a)\b")
    yes = lambda c: F.coalesce(c, F.lit(False))
    xc = (F.col("x0") + F.col("x1")) / 2
    p = pieces.select(*at, "x0", "x1", "text", yes(price if also is None else price | also).alias("_asks"), yes(money).alias("_held")).repartition(*keys)
    # Prices that share a place in their line share a heading; ``_xs`` lists their centres.
    p = p.withColumn("_xs", F.array_sort(F.collect_list(F.when(F.col("_asks"), xc)).over(seq.W.partitionBy(*at))))
    p = p.withColumn("_held", F.max("_held").over(seq.W.partitionBy(*keys, "line")))
    spans = F.when(~F.col("_held") & F.col("line").isNotNull(), F.sequence(F.floor((F.col("x0") - 4) / cell), F.floor((F.col("x1") + 4) / cell)))
    spans = F.transform(F.coalesce(spans, F.array().cast("array<bigint>")), lambda g: F.struct(g.alias("g"), F.lit(False).alias("ask")))
    own = F.when(F.col("_asks"), F.array(F.struct(F.floor(xc / cell).alias("g"), F.lit(True).alias("ask")))).otherwise(F.array().cast("array<struct<g:bigint,ask:boolean>>"))
    p = p.select(*at, "x0", "x1", "text", "_xs", F.explode(F.concat(spans, own)).alias("_c")).select(*at, "x0", "x1", "text", "_xs", "_c.g", "_c.ask")
    asked = F.collect_set(F.when(F.col("ask") & xc.isNotNull(), F.struct(F.col("_xs").alias("xs"), xc.alias("xc")))).over(seq.W.partitionBy(*keys, "g"))
    p = p.withColumn("_asked", asked)
    over = F.filter("_asked", lambda a: a.xc.between(F.col("x0") - 4, F.col("x1") + 4))
    over = F.transform(over, lambda a: F.struct(a.xs.alias("xs"), F.array_repeat(F.struct(F.col("x0").alias("x"), F.col("text").alias("t")), F.size(F.filter(a.xs, lambda x: x == a.xc))).alias("h")))
    me = F.array(F.struct(F.col("_xs").alias("xs"), F.lit(None).cast("array<struct<x:double,t:string>>").alias("h")))
    met = p.select(*keys, "line", F.when(F.col("ask"), F.struct("w")).alias("_w"), F.explode(F.when(F.col("ask"), me).otherwise(over)).alias("_m"))
    met = met.groupBy(*keys, F.col("_m.xs").alias("_xs"), "line").agg(F.collect_list("_w").alias("_ws"), F.flatten(F.collect_list("_m.h")).alias("_h"))
    said = F.when(F.size("_h") > 0, F.array_join(F.transform(F.array_sort("_h"), lambda s: s.t), " "))
    met = met.select(*keys, "_xs", "line", "_ws", said.alias("_h"))
    codes = (text.is_code(F.col("_h")) | F.col("_h").rlike(r"^[0-9A-Z]{1,4}[†*]?$")) & ~finish_list(F.col("_h"))
    above = F.last(F.when(~codes, F.col("_h")), ignorenulls=True).over(seq.W.partitionBy(*keys, "_xs").orderBy("line").rowsBetween(seq.W.unboundedPreceding, -1))
    told = met.withColumn("heading", above).select(*keys, "line", F.explode("_ws").alias("_w"), "heading").select(*keys, "line", "_w.w", "heading")
    named = reduce(Column.__and__, [F.col(c).isNotNull() for c in at])  # a price whose place is not known has no heading
    return told.withColumn("heading", F.when(named, F.coalesce("heading", F.lit(""))).otherwise(F.lit("")))


def finish_list(c):
    words = F.filter(F.split(c, r"\s*(?:/|\bor\b|,)\s*|\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(vocab.FINISH_HEAD_RE))


def search(lines: DataFrame, queries: dict[str, str], first: int | None = None, last: int | None = None, pages: int = 12, per_page: int = 4) -> DataFrame:
    """Pages a text is printed on: the first ``pages`` of a book with up to ``per_page`` lines, the rest as numbers only.

    ``lines(doc, page, line, text)``. One pass over the text serves all queries.
    """
    from mullion.operators.ranking import smallest

    wanted = {n: text.phrase_pattern(x) for n, x in queries.items()}
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in wanted.items() if p]))
    l = lines
    if first is not None:
        l = l.filter(F.col("page") >= first)
    if last is not None:
        l = l.filter(F.col("page") <= last)
    hit = l.withColumn("query", F.explode(found)).select("query", "doc", "page", "line", F.substring("text", 1, 300).alias("text"))
    keys = ["query", "doc", "page"]
    n = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))
    front = smallest(n, ["query", "doc"], [F.col("page")], pages).select(*keys, "rn")
    shown = smallest(hit.join(front.drop("rn"), keys, "left_semi"), keys, [F.col("line")], per_page).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s.text).alias("lines"))
    return n.join(front, keys, "left").join(shown, keys, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def page_text(pieces: DataFrame, keys) -> DataFrame:
    """Each page's text: printed lines top to bottom, their pieces joined with ' | '."""
    from mullion.operators import sequence as seq

    keys = list(keys)
    p = pieces.withColumn("_yc", (F.col("y0") + F.col("y1")) / 2)
    l = seq.mean_lines(p, keys, "_yc", 2.5, 64.0)
    row = l.groupBy(*keys, "line_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s.text), " | ").alias("t"))
    return row.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "t"))), lambda s: s.t), "\n").alias("text"))


def mapped_books(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Books per maker that are known and have a stored first page. ``registry(book, maker, readers)`` lists the known books."""
    first = pages.filter("pdf_page = 1").select("book").distinct()
    return first.join(small(registry), "book").groupBy("maker").agg(F.array_sort(F.collect_set("book")).alias("books"))


def merge_guides(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(families, notes) of a book's guide: families of the same name replaced, notes united in first-seen order.

    Rows are (book, kind 'family' | 'note', pos, name, body).
    """
    fam_new, fam_old = new.filter("kind = 'family'"), old.filter("kind = 'family'")
    families = fam_old.join(fam_new.select("book", "name").distinct(), ["book", "name"], "left_anti").select("book", "name", "body").unionByName(fam_new.select("book", "name", "body"))
    both = old.filter("kind = 'note'").withColumn("_o", F.lit(0)).unionByName(new.filter("kind = 'note'").withColumn("_o", F.lit(1)))
    notes = both.groupBy("book", "body").agg(F.min(F.struct("_o", "pos")).alias("at"))
    return families, notes.select("book", "body", F.col("at._o").alias("load"), F.col("at.pos").alias("pos"))


def plan_calls(found: DataFrame, max_pages: int = 4, max_products: int = 15) -> DataFrame:
    """Read batches: a product joins the first batch sharing a page that stays within both caps.

    Products without a common page never meet, so each maker's product-page graph is cut into its
    connected pieces; a piece is then streamed in order through one task, which holds its batches only.
    ``found(maker, product, pos, page)`` one row per page; returns (maker, product, piece, batch).
    """
    import pandas as pd

    from mullion.operators import graph

    f = found.withColumn("pid", F.xxhash64("maker", "product"))
    first = f.groupBy("maker", "page").agg(F.min("pid").alias("hub"))
    links = f.join(first, ["maker", "page"]).select(F.col("pid").alias("a"), F.col("hub").alias("b"))
    piece = graph.components(links)
    one = f.groupBy("maker", "product", "pid").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set("page")).alias("pages"))
    ready = one.join(piece.withColumnRenamed("id", "pid"), "pid", "left").withColumn("piece", F.coalesce("component", "pid"))
    ordered = ready.select("maker", "piece", "pos", "product", "pages").repartition("maker", "piece").sortWithinPartitions("maker", "piece", "pos", "product")

    def batches(frames):
        at, open_batches = None, []
        for pdf in frames:
            out = []
            for maker, piece_id, product, pages in zip(pdf.maker, pdf.piece, pdf["product"], pdf.pages):
                if (maker, piece_id) != at:
                    at, open_batches = (maker, piece_id), []
                mine = set(pages)
                home = next((i for i, b in enumerate(open_batches) if b[0] & mine and b[1] < max_products and len(b[0] | mine) <= max_pages), None)
                if home is None:
                    open_batches.append([set(), 0])
                    home = len(open_batches) - 1
                open_batches[home][0] |= mine
                open_batches[home][1] += 1
                out.append((maker, product, piece_id, home))
            yield pd.DataFrame(out, columns=["maker", "product", "piece", "batch"])

    return ordered.mapInPandas(batches, "maker string, product string, piece long, batch long")
