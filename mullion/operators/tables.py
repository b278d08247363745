"""Recovered tables: headings, columns, rows and whether they are a door schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from mullion.functions import text
from mullion.operators.spatial import points_in_intervals
from mullion.runtime import cut, small


def map_headers(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``fields`` to tables with ``headers``: the canonical field of each heading.

    Claims are worked out once per distinct heading, not once per table: sheets
    repeat a few headings, and the claim test is the expensive part.
    """
    cells = tables.select(*keys, F.posexplode("headers").alias("i", "h"))
    claims = (cells.select("h").distinct().withColumn("t", text.norm_header(F.col("h")))
              .withColumn("c", text.header_claims(F.col("t"))))
    joined = cells.join(small(claims), "h").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "t", "c"))).alias("_r"))
    granted = joined.select(*keys, text.grant_headers(F.col("_r.t"), F.col("_r.c")).alias("fields"))
    return tables.join(granted, list(keys), "left")


def one_reading(tables: DataFrame, rows: DataFrame, page: Sequence[str], table: Sequence[str], order) -> DataFrame:
    """Readings of one table taken best first; one sharing most of its tags with a kept one is dropped.

    A page of few tagged rows is folded in order, its readings side by side; pages of more than ``PAGE_ROWS`` are settled
    in rounds over all of them. Both give the same answer.
    """
    page, table = list(page), list(table)
    tagged = rows.filter("door_tag <> ''").select(*page, *table, "door_tag")
    crowded = cut(tagged.groupBy(*page).agg(F.count(F.lit(1)).alias("_load")).filter(F.col("_load") > PAGE_ROWS).select(*page))
    if crowded.isEmpty():
        return _read_in_order(tables, tagged, page, table, order)
    # A page with a null in its key is equal to none: its readings have no rivals, and stay.
    few = _read_in_order(tables.join(crowded, page, "left_anti"), tagged.join(crowded, page, "left_anti"), page, table, order)
    many = _read_in_rounds(tables.join(crowded, page, "left_semi"), tagged.join(crowded, page, "left_semi"), page, table, order)
    return few.unionByName(many)


#: Tagged rows of a page up to which its readings are folded side by side.
PAGE_ROWS = 4096


def _read_in_order(tables: DataFrame, tagged: DataFrame, page: list[str], table: list[str], order) -> DataFrame:
    sets = tagged.groupBy(*page, *table).agg(F.collect_set("door_tag").alias("_tags"))
    ranked = tables.select("*", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *table).alias("_rank")).join(sets, [*page, *table], "left")
    alone = ranked.filter("_tags IS NULL").select(*tables.columns)
    row = F.struct("_rank", F.struct(*tables.columns).alias("row"), F.col("_tags").alias("tags"))
    held = ranked.filter("_tags IS NOT NULL").groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    same = lambda a, k: F.size(F.array_intersect(a.tags, k.tags)) * 2 > F.size(a.tags)
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda s, a: F.when(F.exists(s, lambda k: same(a, k)), s).otherwise(F.concat(s, F.array(a))))
    return alone.unionByName(held.select(F.explode(F.transform(kept, lambda k: k.row)).alias("r")).select("r.*").select(*tables.columns))


def _read_in_rounds(tables: DataFrame, rows: DataFrame, page: list[str], table: list[str], order) -> DataFrame:
    from mullion.operators import graph

    ranked = tables.withColumn("_id", F.to_json(F.struct(*page, *table))).withColumn(
        "_rank", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *table))
    tags = rows.distinct()
    tags = tags.join(ranked.select(*page, *table, "_id", "_rank"), [*page, *table])
    size = tags.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    other = tags.select(*page, "door_tag", F.col("_id").alias("rival"), F.col("_rank").alias("_rr"))
    shared = (tags.join(other, [*page, "door_tag"]).filter("_rr < _rank").groupBy("_id", "rival").agg(F.count(F.lit(1)).alias("_s"))
              .join(size, "_id").filter("_s * 2 > _n").select(F.col("_id").alias("id"), "rival"))
    kept = graph.first_fit(ranked.select(F.col("_id").alias("id")), shared)
    return ranked.join(kept.withColumnRenamed("id", "_id"), "_id", "left_semi").drop("_id", "_rank")


def column_of(bounds, x):
    """Index of the half-open column [lo, hi) holding x, null outside."""
    below = F.size(F.filter(bounds, lambda b: b <= x))
    return F.when((below > 0) & (below < F.size(bounds)), below - 1)


def body_items(items: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of a table's body: under the header, above its bottom, in a column."""
    j = items.join(grid, list(keys)).withColumn("col", column_of(F.col("bounds"), F.col("x0")))
    cy = (F.col("y0") + F.col("y1")) / 2
    return j.filter(F.col("horizontal") & (F.col("y0") > F.col("header_bottom")) & (F.col("bottom").isNull() | (cy <= F.col("bottom"))) & F.col("col").isNotNull())


# Rows ---------------------------------------------------------------------

def is_noise(cells, tag_col=0):
    """Nothing filled; only a tag of up to two characters; or nothing but single marks. ``tag_col`` is a number or a column."""
    filled = F.filter(cells, lambda c: c != "")
    tag = F.coalesce(F.get(cells, F.lit(tag_col) if isinstance(tag_col, int) else tag_col), F.lit(""))
    return (F.size(filled) == 0) | ((F.size(filled) == 1) & (tag != "") & (F.length(tag) <= 2)) | F.forall(
        filled, lambda c: (F.length(c) <= 1) & ~c.rlike(r"[\p{L}\p{N}]"))


def is_band(cells):
    """One filled cell that is not a door number: a label for the rows below."""
    filled = F.filter(F.transform(cells, F.trim), lambda c: c != "")
    return (F.size(filled) == 1) & ~text.is_tag(text.join_split_mark(F.coalesce(F.get(filled, F.lit(0)), F.lit(""))))


def is_heading_row(tag):
    """A label where a door number would be: a known heading, or letters alone."""
    t = text.norm_header(tag)
    return (t != "") & (t.isin(text.vocab.HEADING_TAGS) | (~t.rlike("[0-9]") & (F.length(t) >= 3)))


def looks_like_header(cells, headers):
    """A row repeating the headings: it shares max(2, half of its own distinct cells) with them."""
    norm = lambda a: F.array_distinct(F.transform(F.filter(a, lambda c: c != ""), text.norm_header))
    row, head = norm(cells), norm(headers)
    return (F.size(row) > 0) & (F.size(head) > 0) & (
        F.size(F.array_intersect(row, head)) >= F.greatest(F.lit(2), F.floor(F.size(row) / 2)))


def reads_as_headers(c):
    """Two or more words, every one a known heading or group word."""
    # Words that group columns.
    groups = ["DOOR", "DOORS", "FRAME", "FRAMES", "OPENING", "OPENINGS", "LEAF", "LEAVES", "PANEL", "PANELS", "DETAILS",
              "DIMENSION", "DIMENSIONS", "AND", "OF", "TOTAL"]
    words = F.filter(F.split(F.upper(c), r"[^A-Z0-9.#_]+"), lambda w: w != "")
    return (F.size(words) >= 2) & F.forall(words, lambda w: w.isin(groups) | (F.size(text.header_words(w)) > 0))


def is_caption(c):
    t = F.trim(c)
    return F.length(t).between(1, 80) & ~reads_as_headers(t) & ~F.startswith(F.ltrim(F.upper(t)), F.lit("NOTE"))


def metric_columns(cells: DataFrame, table: Sequence[str]) -> DataFrame:
    """(table, col) whose filled cells are mostly metric sizes, never the tag column.

    ``cells`` is long: one row per (table, row, col) with value and field.
    """
    from mullion.functions import sizes

    n = cells.filter("coalesce(field, '') <> 'door_tag' AND trim(value) <> ''").groupBy(*table, "col").agg(
        F.count(F.lit(1)).alias("filled"), F.count(F.when(sizes.is_metric(F.col("value")), 1)).alias("metric"))
    return n.filter("metric > 0 AND metric * 2 > filled").select(*table, "col")


def drop_data_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Heading lines without the trailing run that reads as data; the first line always stays.

    ``lines(keys, line, cells, numeric)`` holds one row per heading line.
    """
    data = (F.col("cells") >= 3) & (F.col("numeric") >= F.col("cells") * 0.6)
    last = lines.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(F.when(~data, F.col("line"))), F.min("line")), F.min("line")).alias("_last"))
    return lines.join(last, list(keys)).filter(F.col("line") <= F.col("_last")).drop("_last")


def tag_evidence(rows: DataFrame, table: Sequence[str]) -> DataFrame:
    """Per table: rows, tagged rows, distinct tags, tag-shaped tags, and whether the tags number doors."""
    t = F.when(F.coalesce("door_tag", F.lit("")) != "", F.col("door_tag"))
    n = rows.groupBy(*table).agg(F.count(F.lit(1)).alias("rows"), F.count(t).alias("tagged"), F.countDistinct(t).alias("distinct_tags"),
                                 F.count(F.when(text.is_tag(t), 1)).alias("shaped"))
    return n.withColumn("names_doors", (F.col("tagged") >= 2) & (F.col("distinct_tags") * 2 >= F.col("tagged")) & (F.col("shaped") * 2 >= F.col("tagged")))


def looks_like_schedule(evidence: DataFrame) -> DataFrame:
    """Adds ``accepted``; needs rows, fields (mapped count), has_tag, names_doors and foreign."""
    weak = F.col("has_tag") & (F.col("fields") >= 3) & F.col("names_doors") & ~F.col("foreign")
    return evidence.withColumn("accepted", (F.col("rows") >= 2) & ((F.col("fields") >= 4) | weak))


def is_thin(cells: DataFrame, table: Sequence[str]) -> DataFrame:
    """Tables with too few columns (under five) or too few filled cells (under 30 %)."""
    n = cells.groupBy(*table).agg(F.countDistinct("col").alias("columns"), F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("value") != "", 1)).alias("filled"))
    return n.withColumn("thin", (F.col("columns") < 5) | (F.col("filled") < F.col("cells") * 0.3))


def column_samples(cells: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """First ``k`` distinct values of each column, in row order."""
    from mullion.operators.ranking import smallest

    first = cells.filter("value <> ''").groupBy(*keys, "value").agg(F.min("row").alias("row"))
    return smallest(first, keys, [F.col("row"), F.col("value")], k).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s.value).alias("samples"))


def infer_tag_column(cells: DataFrame, table: Sequence[str]) -> DataFrame:
    """The column that numbers the rows: filled on 60 %, short, 90 % distinct; most distinct, then leftmost."""
    v = F.when(F.trim("value") != "", F.trim("value"))
    n = cells.groupBy(*table, "col").agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("filled"), F.countDistinct(v).alias("kinds"), F.max(F.length(v)).alias("longest"))
    ok = n.filter("filled >= 3 AND filled >= rows * 0.6 AND longest <= 10 AND kinds >= filled * 0.9")
    return ok.groupBy(*table).agg(F.max_by("col", F.struct(F.col("kinds") / F.col("filled"), -F.col("col"))).alias("col"))


def settle_fields(columns: DataFrame, table: Sequence[str]) -> DataFrame:
    """Headings checked against values; one row per table with the settled ``fields`` and ``size_col``.

    ``columns`` has, per (table, col): field, header (normalised), rows, filled, marks
    (single non-letter values) and pairs (values holding two sizes). A table has few columns.
    """
    c = columns.withColumn("field", F.when(F.col("field").isin("hw_set", "door_type") & (F.col("filled") > 0) & (F.col("marks") == F.col("filled")), "").otherwise(F.col("field")))
    t = c.groupBy(*table).agg(F.max("rows").alias("_rows"), F.array_sort(F.collect_list(F.struct("col", "field", "header", "filled", "pairs"))).alias("_c"))

    def settle(df: DataFrame, field: str, word: str) -> DataFrame:
        mine = F.get(F.filter("_c", lambda x: x.field == field), F.lit(0))
        good = F.coalesce(mine.filled * 2 >= F.col("_rows"), F.lit(False))
        able = F.filter("_c", lambda x: ((x.field == "") | (x.field == field)) & F.contains(F.concat(F.lit(" "), x.header, F.lit(" ")), F.lit(f" {word} "))
                        & (x.filled * 2 >= F.col("_rows")))
        best = F.array_max(F.transform(able, lambda x: F.struct(x.filled.alias("filled"), (-x.col).alias("left"))))
        df = df.withColumn("_good", good).withColumn("_to", F.when(~good, -best.left))
        return df.withColumn("_c", F.when(F.col("_good"), F.col("_c")).otherwise(F.transform("_c", lambda x: F.struct(
            x.col.alias("col"), F.when(x.col == F.col("_to"), field).when(x.field == field, "").otherwise(x.field).alias("field"),
            x.header.alias("header"), x.filled.alias("filled"), x.pairs.alias("pairs"))))).drop("_good", "_to")

    t = settle(settle(t, "door_width", "WIDTH"), "door_height", "HEIGHT")
    fields = F.transform("_c", lambda x: x.field)
    pair = F.filter("_c", lambda x: (x.field == "") & (x.filled > 0) & (x.filled * 2 >= F.col("_rows")) & (x.pairs * 2 > x.filled))
    lacking = ~F.array_contains(fields, "door_width") | ~F.array_contains(fields, "door_height")
    return t.select(*table, fields.alias("fields"), F.when(lacking, F.get(pair, F.lit(0)).col).alias("size_col"))


def levels_from_titles(titles: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Level of each table of a document: its title without what all titles share.

    The prefix two extreme titles share is the prefix all share, so a document's
    titles meet only in min, max and a few counts.
    """
    doc = list(doc)
    t = titles.withColumn("t", F.regexp_replace(F.trim("title"), r"\s+", " ")).filter("t <> ''")
    letter = F.length(F.regexp_extract("t", r"^(.*\p{L})", 1))
    g = t.groupBy(*doc).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min(F.length("t")).alias("shortest"), F.max(letter).alias("letter"))
    upto = F.sequence(F.lit(1), F.col("shortest"))
    shared = F.size(F.filter(upto, lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    g = g.filter("a <> b").withColumn("shared", shared).filter("shared < shortest")
    cuts = F.filter(F.sequence(F.lit(0), F.col("shared")), lambda i: (i == 0) | (F.substring("a", i, F.lit(1)).isin(" ", "_", "-", ":") & (i < F.col("letter"))))
    g = g.withColumn("cut", F.array_max(cuts)).select(*doc, "cut")
    named = t.join(g, doc).withColumn("level", F.btrim(F.substr("t", F.col("cut") + 1), F.lit(" _-:")))
    whole = named.groupBy(*doc).agg(F.min(F.col("level") != "").alias("_ok"))
    return named.join(whole.filter("_ok"), doc).filter(F.col("level") != F.trim("title")).drop("_ok", "t", "cut")


def drop_attached(rows: DataFrame, values: DataFrame, doc: Sequence[str], table: Sequence[str]) -> DataFrame:
    """Tables that are not attached to another: under half of their rows (or under three) name another table's door.

    ``rows(doc, table, row, door_tag)``; ``values(doc, table, row, value)``. When every
    table of a document is attached, all stay.
    """
    doc, table = list(doc), list(table)
    keys = [*doc, *table]
    tags = rows.filter("door_tag <> ''").select(*keys, "door_tag").distinct()
    owners = tags.groupBy(*doc, "door_tag").agg(F.count(F.lit(1)).alias("_owners"))
    own = tags.select(*keys, F.col("door_tag").alias("word")).withColumn("_own", F.lit(True))
    words = values.withColumn("word", F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))).select(*keys, "row", "word").distinct()
    hits = (words.join(owners.withColumnRenamed("door_tag", "word"), [*doc, "word"]).join(own, [*keys, "word"], "left")
            .filter("_own IS NULL").select(*keys, "row").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits")))
    t = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(hits, keys, "left")
    t = t.withColumn("_drop", F.coalesce((F.col("_hits") >= 3) & (F.col("_hits") >= F.col("_n") * 0.5), F.lit(False)))
    all_of = t.groupBy(*doc).agg(F.min("_drop").alias("_all"))
    return t.join(all_of, doc).filter("NOT _drop OR _all").select(*keys)


def order_holds(schedules: DataFrame, doors: DataFrame) -> DataFrame:
    """Documents whose doors can be told apart by order: no two tables share page and row count, and the rows add up."""
    dup = schedules.groupBy("document_id", "page", "row_count").agg(F.count(F.lit(1)).alias("_n"), F.sum("row_count").alias("_rows"))
    tables = dup.groupBy("document_id").agg(F.max("_n").alias("_dup"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("_total"))
    last = doors.groupBy("document_id").agg((F.max("row_index") + 1).alias("_last"))
    return tables.join(last, "document_id").filter("_dup = 1 AND _total = _last").select("document_id")


def doors_by_order(schedules: DataFrame, doors: DataFrame) -> DataFrame:
    """Doors with the table they came from by running row ranges: page first, the longer table first on a page.

    Refused for a document where ``order_holds`` does not. ``schedules(document_id, page, table, row_count)``.
    """
    # Each table's range is listed by row index, so the match is an equi join.
    rows = seq_running(schedules).filter("row_count > 0").select("document_id", "table", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("row_count") - 1)).alias("row_index"))
    return doors.join(order_holds(schedules, doors), "document_id", "left_semi").join(rows, ["document_id", "row_index"])


def seq_running(schedules: DataFrame) -> DataFrame:
    from mullion.operators import sequence as seq

    d = schedules.withColumn("_longer", -F.coalesce(F.col("row_count"), F.lit(0)))
    d = seq.running(d, ["document_id"], F.floor(F.col("page") / 64), ["page", "_longer", "table"], {"_before": ("sum", F.col("row_count"))}, inclusive=False)
    return d.withColumn("_start", F.col("_before").cast("bigint")).drop("_longer")


def leave_out_removed(tables: DataFrame, removed: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Tables nobody removed before: same page and same title, case and spaces aside."""
    norm = F.trim(F.regexp_replace(F.upper("title"), r"\s+", " "))
    gone = removed.select(*doc, "page", norm.alias("_t")).distinct()
    return tables.withColumn("_t", norm).join(gone, [*doc, "page", "_t"], "left_anti").drop("_t")


# Grids --------------------------------------------------------------------

def ruled_grid(headers: DataFrame, rulings: DataFrame, keys: Sequence[str], tol: float = 4.0) -> DataFrame:
    """Column and row bounds of ruled tables.

    ``headers(keys, hx0, hy0, hx1, hy1, tag_x)`` is each table's header block, ``rulings(page keys, axis, pos, start, end)``.
    A vertical rule counts where it crosses 45 % of the header (at least 4 pt); a horizontal one where it covers 70 %
    of the width; rows end at the first gap over three times the upper-median one. The rules of one page stay together.
    """
    from mullion.operators import sequence as seq

    keys = list(keys)
    page = [k for k in keys if k in rulings.columns]
    h = headers.withColumn("need", F.greatest((F.col("hy1") - F.col("hy0")) * 0.45, F.lit(tol)))

    def grouped(axis: str) -> DataFrame:
        r = seq.anchored(rulings.filter(F.col("axis") == axis).select(*page, "pos", "start", "end"), page, "pos", tol, None)
        return r.select(*page, F.avg("pos").over(W.partitionBy(*page, "cluster")).alias("at"), F.col("start").alias("s"), F.col("end").alias("e"))

    v = grouped("v").join(h, page)
    clip = v.filter((F.col("e") > F.col("hy0")) & (F.col("s") < F.col("hy1"))).select(
        *keys, "at", F.greatest("s", "hy0").alias("s"), F.least("e", "hy1").alias("e"))
    cover = seq.coverage(clip, [*keys, "at"], "s", "e", F.lit(float("-inf")), F.lit(float("inf")), None)
    cols = cover.join(h, keys).filter("covered >= need").groupBy(*keys, "hx0", "hx1", "hy0", "hy1", "tag_x").agg(F.array_sort(F.collect_set("at")).alias("xs"))
    cols = cols.withColumn("left", F.array_max(F.filter("xs", lambda x: x <= F.col("hx0") + 2))).withColumn("right", F.array_min(F.filter("xs", lambda x: x >= F.col("hx1") - 2)))
    cols = cols.filter((F.size("xs") >= 4) & (F.col("right") - F.col("left") >= 100))
    cols = cut(cols.withColumn("bounds", F.filter("xs", lambda x: x.between(F.col("left"), F.col("right")))).filter(F.size("bounds") >= 4))
    hz = grouped("h").join(cols.select(*keys, "left", "right", "hy0", "hy1"), page)
    hclip = hz.filter((F.col("e") > F.col("left")) & (F.col("s") < F.col("right"))).select(*keys, "at", F.greatest("s", "left").alias("s"), F.least("e", "right").alias("e"))
    rows = seq.coverage(hclip, [*keys, "at"], "s", "e", F.lit(float("-inf")), F.lit(float("inf")), None).join(cols.select(*keys, "left", "right"), keys)
    ys = rows.filter(F.col("covered") >= (F.col("right") - F.col("left")) * 0.7).groupBy(*keys).agg(F.array_sort(F.collect_set("at")).alias("ys"))
    g = cols.join(ys, keys)
    g = g.withColumn("header_bottom", F.array_min(F.filter("ys", lambda y: y >= F.col("hy1") - 2))).withColumn(
        "header_top", F.coalesce(F.array_max(F.filter("ys", lambda y: y <= F.col("hy0") + 2)), F.col("hy0") - 2))
    # Each step is bound to a name once: a filter on the result would otherwise write the whole expression out many times over.
    below = F.filter("ys", lambda y: y >= F.col("header_bottom") - 0.5)
    gaps = lambda b: F.transform(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), lambda y, i: y - F.get(b, i))
    usual = lambda d: F.get(F.array_sort(d), F.floor(F.size(d) / 2).cast("int"))
    stop = lambda d: let(usual(d), lambda u: F.array_position(F.transform(d, lambda x: x > u * 3), True))
    kept = lambda b: let(let(gaps(b), stop), lambda at: F.when(at == 0, b).otherwise(F.slice(b, 1, at.cast("int"))))
    g = cut(g.withColumn("row_bounds", let(below, lambda b: F.when(F.size(b) >= 3, kept(b)))))
    return g.filter(F.size("row_bounds") >= 3).select(*keys, "left", "right", "header_top", "header_bottom", "bounds", "row_bounds", "tag_x")


def let(value, fn):
    """``fn`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def trim_to_tagged(grid: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows below the last one with a tag go, judged in the column holding most tags (nearest the seed on a tie)."""
    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    cy = (F.col("y0") + F.col("y1")) / 2
    j = items.filter(F.col("horizontal") & text.is_tag(F.col("text"))).join(grid, page)
    j = j.withColumn("col", column_of(F.col("bounds"), F.col("x0"))).withColumn("row", column_of(F.col("row_bounds"), cy)).filter("col IS NOT NULL AND row IS NOT NULL")
    per = j.groupBy(*keys, "col").agg(F.countDistinct("row").alias("n"), F.max("row").alias("last"), F.first(F.abs(F.element_at("bounds", F.col("col") + 1) - F.col("tag_x"))).alias("d"))
    best = per.groupBy(*keys).agg(F.max_by("last", F.struct("n", -F.col("d"), -F.col("col"))).alias("_last"))
    return grid.join(best, keys, "left").withColumn("row_bounds", F.when(F.col("_last").isNull(), F.col("row_bounds")).otherwise(F.slice("row_bounds", F.lit(1), F.col("_last") + 2))).drop("_last")


def banded_grid(items: DataFrame, headers: DataFrame, keys: Sequence[str], tol: float = 6.0) -> DataFrame:
    """Columns of an unruled table from the left edges its data shares.

    A column starts where max(2, n / 200) items share a left edge; with under three such
    edges the table has no banded grid (callers fall back on heading centres).
    """
    from mullion.operators import sequence as seq

    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    d = items.filter("horizontal").join(headers, page).filter((F.col("y0") > F.col("hy1")) & F.col("x0").between(F.col("hx0") - 60, F.col("hx1") + 60))
    c = seq.anchored(d.select(*keys, "x0", "x1", "hx1"), keys, "x0", tol, None)
    starts = c.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("x1").alias("_x1"), F.first("hx1").alias("_hx1"))
    g = starts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "n"))).alias("_c"), F.sum("n").alias("_n"), F.greatest(F.first("_hx1") + 60, F.max("_x1") + 3).alias("right"))
    often = F.filter("_c", lambda c: c.n >= F.greatest(F.lit(2), F.floor(F.col("_n") / 200)))
    g = g.withColumn("xs", F.transform(often, lambda c: c.cluster)).filter(F.size("xs") >= 3)
    return g.select(*keys, F.concat(F.array(F.get("xs", F.lit(0)) - 3), F.slice("xs", F.lit(2), F.size("xs")), F.array("right")).alias("bounds"))


def aligned_grid(items: DataFrame, seeds: DataFrame, keys: Sequence[str], on_row: float = 2.5) -> DataFrame:
    """Rows and columns of a table drawn with neither rules nor bands, from the pitch of its tag column.

    ``seeds(keys, seed_x, seed_y)``: where the tag column and its heading stand. Rows are the longest evenly
    pitched run of tags; columns are x spans covered by cells on those rows; neighbours left and
    right of the tag column join while most of what they hold sits on the rows and no wide gutter opens
    a table of its own.
    """
    from mullion.operators import sequence as seq

    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    flat = cut(items.filter("horizontal").join(seeds, page).withColumn("cy", F.bround((F.col("y0") + F.col("y1")) / 2, 1)).withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
               .filter("y1 > seed_y").select(*keys, "x0", "x1", "cx", "cy", "text", "seed_x"))
    door = flat.filter(text.is_tag(F.col("text")) & (F.abs(F.col("x0") - F.col("seed_x")) <= 6))
    run = seq.longest_run(door.select(*keys, F.col("cy").alias("v")), keys, "v", 3.0, 256.0).filter("rows >= 5")
    rows = cut(door.join(run, keys).filter(F.col("cy").between(F.col("top"), F.col("bottom"))).select(*keys, "cy", "top", "bottom", "pitch").distinct())
    band = flat.join(run, keys).filter(F.col("cy").between(F.col("top") - F.col("pitch") / 2, F.col("bottom") + F.col("pitch") / 2))
    near = rows.select(*keys, F.col("cy").alias("ry")).withColumn("_g", F.explode(F.sequence(F.floor((F.col("ry") - on_row) / 8), F.floor((F.col("ry") + on_row) / 8))))
    band = cut(band.select(*keys, "x0", "x1", "cx", "cy", "text"))  # all of the body and what stands on its rows are read three times each
    hit = band.withColumn("_g", F.floor(F.col("cy") / 8)).join(near, [*keys, "_g"]).filter(F.abs(F.col("ry") - F.col("cy")) <= on_row)
    on = cut(hit.select(*keys, "x0", "x1", "cx", "cy", "text").distinct())
    stray = run.select(*keys, F.greatest(F.lit(1), F.floor(F.col("rows") / 25)).alias("stray"))
    spans = cut(seq.histogram_spans(on, keys, "x0", "x1", stray, 512.0).join(run.select(*keys, "rows"), keys))
    # A table has few spans (its columns), so they ride along as one list and no span meets an item it does not cross.
    columns = spans.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    in_span = lambda df: df.join(columns, keys).withColumn("_s", F.explode(F.filter("_spans", lambda s: (F.col("x1") > s.lo) & (F.col("x0") < s.hi)))).withColumn("lo", F.col("_s.lo"))
    held = in_span(band).groupBy(*keys, "lo").agg(F.count(F.lit(1)).alias("all"))
    good = in_span(on).groupBy(*keys, "lo").agg(F.count(F.lit(1)).alias("aligned"), F.countDistinct("text").alias("kinds"), F.min(text.is_tag(F.col("text"))).alias("tags"))
    s = spans.join(held, [*keys, "lo"], "left").join(good, [*keys, "lo"], "left").join(seeds.select(*keys, "seed_x"), keys)
    s = s.withColumn("belongs", F.coalesce(F.col("aligned") >= F.col("all") * 0.6, F.lit(False))).withColumn(
        "starts", F.coalesce((F.col("aligned") >= F.col("rows") * 0.8) & F.col("tags") & (F.col("kinds") >= F.col("aligned") * 0.9), F.lit(False)))
    # The spans of one table are few (its columns), so they are put in order per table.
    t = s.groupBy(*keys, "seed_x", "rows").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "belongs", "starts"))).alias("c"))
    gut = F.array_sort(F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x, i: x.lo - F.get("c", i).hi))
    t = t.withColumn("_wide", F.greatest(F.lit(40.0), F.coalesce(F.get(gut, F.floor(F.size(gut) / 2).cast("int")), F.lit(40)).cast("double") * 3))
    home = F.array_position(F.transform("c", lambda x: F.col("seed_x").between(x.lo - 1, x.hi + 1)), True)
    t = cut(t.withColumn("_home", home.cast("int"))).filter("_home > 0")
    stops = F.transform("c", lambda x, i: ~x.belongs | (F.when(i < F.col("_home") - 1, F.get("c", i + 1).lo - x.hi).otherwise(x.lo - F.get("c", i - 1).hi).cast("double") > F.col("_wide")) & x.starts)
    t = t.withColumn("_stop", F.transform(stops, lambda b: F.coalesce(b, F.lit(False))))
    first = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.size("c")), lambda i: (i < F.col("_home")) & F.get("_stop", i - 1))), F.lit(0)) + 1
    last = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.size("c")), lambda i: (i > F.col("_home")) & F.get("_stop", i - 1))), F.size("c") + 1) - 1
    t = t.withColumn("_first", first).withColumn("_last", last).withColumn("spans", F.slice("c", F.col("_first"), F.col("_last") - F.col("_first") + 1))
    t = cut(t.drop("c", "_stop")).filter(F.size("spans") >= 4)
    mid = F.transform(F.slice("spans", F.lit(2), F.size("spans")), lambda x, i: (x.lo + F.get("spans", i).hi) / 2)
    t = t.withColumn("bounds", F.concat(F.array(F.get("spans", F.lit(0)).lo - 2.0), mid, F.array(F.element_at("spans", -1).hi + 2.0)))
    return t.join(run.drop("rows"), keys).select(*keys, "bounds", "rows", "top", "bottom", "pitch")


def joined(parts):
    """Texts of one cell in reading order: 3 pt lines, then left to right. ``parts`` is (y0, x0, text) structs."""
    return F.trim(F.array_join(F.transform(F.array_sort(parts), lambda p: p.text), " "))


def reading_part():
    return F.struct(F.bround(F.col("y0") / 3, 0).alias("line"), F.col("x0").alias("x0"), F.col("text").alias("text"))


def cells(items: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Filled cells of ruled tables: (row, col, text) of every item whose left edge and centre a cell holds."""
    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    j = items.filter("horizontal").join(grid.select(*keys, "bounds", "row_bounds"), page)
    j = j.withColumn("col", column_of(F.col("bounds"), F.col("x0"))).withColumn("row", column_of(F.col("row_bounds"), (F.col("y0") + F.col("y1")) / 2))
    return j.filter("col IS NOT NULL AND row IS NOT NULL").groupBy(*keys, "row", "col").agg(joined(F.collect_list(reading_part())).alias("text"))


def header_texts(items: DataFrame, grid: DataFrame, keys: Sequence[str], rulings: DataFrame | None = None, tol: float = 4.0) -> DataFrame:
    """Heading of each column; a group heading is pushed down onto the columns between the rules around it."""
    from mullion.operators import sequence as seq

    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    cy = (F.col("y0") + F.col("y1")) / 2
    band = items.join(grid.select(*keys, "bounds", "header_top", "header_bottom"), page).filter(cy.between(F.col("header_top") - 0.5, F.col("header_bottom") + 0.5))
    own = column_of(F.col("bounds"), F.when(F.col("horizontal"), F.col("x0")).otherwise((F.col("x0") + F.col("x1")) / 2))
    band = band.withColumn("own", own)
    if rulings is None:
        spread = band.filter("own IS NOT NULL").withColumn("col", F.col("own"))
    else:
        # A page has few upright rules, so they ride along as one list.
        rules = rulings.filter("axis = 'v' AND end >= start").groupBy(*page).agg(F.collect_set(F.struct("pos", "start", "end")).alias("_rules"))
        tall = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
        whole = F.col("text").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull()
        beside = F.filter("_rules", lambda r: whole & (F.least(r["end"], F.col("y1")) - F.greatest(r["start"], F.col("y0")) >= tall * 0.45))
        b = band.join(rules, page, "left").withColumn("_rules", F.transform(beside, lambda r: r["pos"]))
        b = b.withColumn("l", F.array_max(F.filter("_rules", lambda p: p <= F.col("x0") + 1))).withColumn("r", F.array_min(F.filter("_rules", lambda p: p >= F.col("x1") - 1))).drop("_rules")
        at = F.sequence(F.lit(0), F.size("bounds") - 2)
        over = F.filter(at, lambda k: (F.get("bounds", k) >= F.col("l") - 1) & (F.get("bounds", k + 1) <= F.col("r") + 1))
        mine = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array().cast("array<int>"))
        spread = b.withColumn("col", F.explode(F.when(F.col("horizontal") & F.col("l").isNotNull() & F.col("r").isNotNull() & (F.size(over) > 0), over).otherwise(mine)))
    return spread.groupBy(*keys, "col").agg(joined(F.collect_list(reading_part())).alias("header"))


def table_bounds(items: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box of each table: its header's top, its columns, and the rule under its lowest text."""
    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    cy = (F.col("y0") + F.col("y1")) / 2
    inside = items.filter("horizontal").join(grid.select(*keys, "bounds", "header_bottom"), page).filter((cy > F.col("header_bottom")) & column_of(F.col("bounds"), F.col("x0")).isNotNull())
    low = inside.groupBy(*keys).agg(F.max("y1").alias("lowest"))
    g = grid.join(low, keys, "left")
    end = F.element_at("row_bounds", -1)
    bottom = F.when(F.col("lowest").isNull(), end).otherwise(F.coalesce(F.array_min(F.filter("row_bounds", lambda b: b >= F.col("lowest") - 1)), end))
    return g.select(*keys, "left", F.least("header_top", "header_bottom").alias("top"), "right", bottom.alias("bottom"))


def table_titles(items: DataFrame, grid: DataFrame, keys: Sequence[str], reach: float = 34.0) -> DataFrame:
    """Caption floating just above each table, unless it reads as headings or is a note."""
    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    band = items.filter("horizontal").join(grid.select(*keys, "left", "right", "header_top"), page).filter(
        cy.between(F.col("header_top") - reach - 0.5, F.col("header_top") + 0.5) & cx.between(F.col("left") - 1, F.col("right") + 1))
    t = band.groupBy(*keys).agg(joined(F.collect_list(F.struct(F.bround(cy / 3, 0).alias("line"), F.col("x0").alias("x0"), F.col("text").alias("text")))).alias("title"))
    return t.filter(is_caption(F.col("title")))


def heading_top(items: DataFrame, grid: DataFrame, keys: Sequence[str], most: int = 2, gap: float = 20.0, cells_least: int = 3, long: int = 32) -> DataFrame:
    """Header top climbed over group-heading lines stacked above it: three or more short cells, at most two lines, 20 pt apart."""
    from mullion.operators import sequence as seq

    keys = list(keys)
    page = [k for k in keys if k in items.columns]
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    near = items.filter("horizontal").join(grid.select(*keys, "left", "right", "header_top"), page).filter(
        (cy < F.col("header_top")) & (cy > F.col("header_top") - 4 * gap * most) & cx.between(F.col("left") - 1, F.col("right") + 1))
    # Lines are numbered upwards, so the ordering value is the negated baseline.
    up = seq.anchored(near.withColumn("_up", -F.col("y0")), keys, "_up", 3.0, None)
    line = up.groupBy(*keys, "header_top", "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("y1").alias("low"), F.min("y0").alias("high"), F.max(F.length("text")).alias("longest"))
    stack = line.groupBy(*keys, "header_top").agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "low", "high", "longest"))).alias("c"))
    start = F.struct(F.col("header_top").alias("top"), F.lit(False).alias("stop"))
    climb = F.aggregate(F.slice("c", 1, most), start, lambda s, x: F.when(
        ~s.stop & (x.n >= cells_least) & (s.top - x.low <= gap) & (x.longest <= long), F.struct((x.high - 2.0).alias("top"), F.lit(False).alias("stop"))).otherwise(
        F.struct(s.top.alias("top"), F.lit(True).alias("stop"))), lambda s: s.top)
    return grid.join(stack.select(*keys, climb.alias("_top")), keys, "left").withColumn("header_top", F.coalesce("_top", "header_top")).drop("_top")


def body_top(lines: DataFrame, values: DataFrame, keys: Sequence[str], share: float = 0.5) -> DataFrame:
    """Top of an aligned table's body: lines above the first row that look like its values belong to it.

    ``lines(keys, line, y0, y1, col, text)`` numbers lines upwards from the first row (1 is nearest);
    ``values(keys, col, text)`` are the body's cells. A line of two or more cells joins while half of them match a
    value, or a value's digit-and-letter shape, of their column.
    """
    from mullion.operators import sequence as seq

    keys = list(keys)
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\d", "9"), "[A-Z]", "A")
    cell = cut(lines.select(*keys, "line", "y0", "col", F.array_distinct(F.array(F.upper(F.trim("text")), shape(F.col("text")))).alias("v")))
    # A table has few lines above its first row, so what they ask for rides along as one list and the body is only looked through,
    # in the order it comes: of its cells no more is kept than what was asked for.
    asked = cell.groupBy(*keys).agg(F.collect_set(F.struct("col", "v")).alias("_asked"))
    forms = values.select(*keys, "col", F.upper(F.trim("text")).alias("_u"), shape(F.col("text")).alias("_s"))
    met = F.filter("_asked", lambda a: (a["col"] == F.col("col")) & (F.array_contains(a["v"], F.col("_u")) | F.array_contains(a["v"], F.col("_s"))))
    known = forms.join(asked.hint("shuffle_hash"), keys).select(*keys, F.explode(met).alias("_met")).select(*keys, "_met.col", "_met.v").distinct()
    hit = cell.join(known.withColumn("_k", F.lit(1)), [*keys, "col", "v"], "left")
    n = seq.known(hit, [*keys, "line"]).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"), F.count("_k").alias("hits"), F.min("y0").alias("y0"))
    bad = F.when((F.col("n") < 2) | (F.col("hits") < F.col("n") * share), F.col("line"))
    took = n.withColumn("_bad", F.min(bad).over(W.partitionBy(*keys))).filter(F.col("_bad").isNull() | (F.col("line") < F.col("_bad")))
    return took.groupBy(*keys).agg((F.min("y0") - 1.0).alias("body_top"), F.count(F.lit(1)).alias("lines"))


def judge(rows: DataFrame, titles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict per table from weighed clues: found at six points, unsure at three, else rejected; with its reasons.

    ``rows`` are extracted rows, ``titles(keys, title, index_level)``. A number column found by its values alone
    (``tag_guessed`` on the rows) counts against the table.
    """
    from mullion.functions import sizes

    keys = list(keys)
    # Columns that describe a door, those nothing else carries, and cells that say nothing.
    door = ["door_width", "door_height", "door_type", "door_material", "door_finish", "frame_material", "frame_finish", "fire_rating", "hw_set", "threshold"]
    only = ["frame_material", "frame_finish", "fire_rating", "hw_set", "threshold"]
    nothing = ["", "-", "--", "–", "—", "X", "N/A", "NA", "TBD", "?"]
    means = lambda c: ~F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))).isin(nothing)

    def size(c):
        feet = sizes.parse_feet(c)
        mm = F.regexp_extract(F.trim(c), r"(?i)^\(?\d?\)?\s*(\d{3,4})(?:\s*mm)?$", 1).try_cast("int")
        return F.coalesce(feet.between(1.5, 14), mm.between(450, 4300), F.lit(False))

    ev = tag_evidence(rows, keys)
    n = rows.groupBy(*keys).agg(*[F.count(F.when(means(F.col(f)), 1)).alias(f"_n_{f}") for f in door], F.count(F.when(size(F.col("door_width")) | size(F.col("door_height")), 1)).alias("_sized"),
                                F.first("headers").alias("headers"), F.first("fields").alias("fields"),
                                (F.max("tag_guessed") if "tag_guessed" in rows.columns else F.lit(False)).alias("_guessed"))
    t = ev.join(n, keys).join(titles, keys, "left").withColumn("title", F.upper(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))))
    headed = F.exists("headers", lambda h: text.contains_any(F.upper(h), text.vocab.SHEET_DOOR_WORDS))
    cap = text.contains_any(F.col("title"), text.vocab.SHEET_DOOR_WORDS)
    other = ~headed & (text.is_other_schedule(F.col("title")) | (F.contains("title", F.lit("SCHEDULE")) & ~cap))
    t = t.withColumns({"_headed": headed, "_cap": cap, "_other": other})
    filled = lambda fs: sum([F.when(F.array_contains("fields", f) & (F.col(f"_n_{f}") >= F.col("rows") * 0.25), 1).otherwise(0) for f in fs])
    described = F.when(F.col("_other"), filled(only)).otherwise(filled(door))
    foreign = F.exists("headers", text.names_another_trade)
    clues = [
        (F.when(F.col("_headed"), 2), "column headings name a door"),
        (F.when(F.col("index_level").isNotNull() & ~F.col("_other"), F.when(F.col("index_level") == "named", 3).otherwise(1)), "listed in the index"),
        (F.when(F.col("_cap"), 3).when(F.col("_other"), -4), "caption"),
        (F.when(described > 0, F.least(described, F.lit(5))).otherwise(-2), "columns that describe a door"),
        (F.when((F.col("_sized") * 2 >= F.col("rows")) & ~F.col("_other"), 2), "sizes a door can have"),
        (F.when(F.array_contains("fields", "door_tag"), F.when(F.col("_guessed"), -1).otherwise(1)).otherwise(-2), "door number column"),
        (F.when(F.col("names_doors"), 1).when((F.col("tagged") >= 2) & (F.col("distinct_tags") * 2 >= F.col("tagged")), 0).otherwise(-2), "door numbers"),
        (F.when(foreign, -4), "columns of another trade"),
    ]
    score = sum([F.coalesce(c, F.lit(0)) for c, _ in clues])
    why = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit(" " + w))) for c, w in clues]))
    return t.select(*keys, "rows", score.alias("score"), F.when(score >= 6, "found").when(score >= 3, "unsure").otherwise("reject").alias("outcome"), why.alias("reasons"))


def detect(verdicts: DataFrame, indexed: DataFrame, doc: Sequence[str]) -> DataFrame:
    """Tables to keep per document: those on index pages, and those of all pages only where the index found none.

    ``verdicts(doc, page, table, score, outcome)``, ``indexed(doc, page)``; adds ``via``.
    """
    doc = list(doc)
    v = verdicts.filter("outcome <> 'reject'").join(indexed.select(*doc, "page", F.lit(True).alias("_ix")).distinct(), [*doc, "page"], "left")
    have = v.filter("_ix AND outcome = 'found'").select(*doc).distinct().withColumn("_have", F.lit(True))
    return v.join(have, doc, "left").filter("_ix OR _have IS NULL").withColumn("via", F.when(F.col("_ix"), "index").otherwise("all pages")).drop("_ix", "_have")
