"""Steps whose cost has to grow with the input: nearness, flags, lists of ids, headings, texts."""

import math
import random

from pyspark.sql import functions as F

from mullion.functions import text
from mullion.operators import detections, fonts, locate, plans, spatial
from mullion.sources import spans


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_cells_give_the_same_pairs_and_keep_lone_points(spark):
    rnd = random.Random(3)
    spots = [(i % 3, i, rnd.uniform(-90, 90), rnd.uniform(-60, 60)) for i in range(240)]
    a, b = [s for s in spots if s[1] % 2], [s for s in spots if not s[1] % 2]
    points = spark.createDataFrame(a, "page bigint, p bigint, cx double, cy double")
    others = spark.createDataFrame(b, "page bigint, o bigint, ox double, oy double")
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and abs(x[2] - y[2]) <= 9 and abs(x[3] - y[3]) <= 6}
    got = [(r.p, r.o) for r in spatial.points_near(points, others, ["page"], 9.0, 6.0, cells=4, how="left").collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[1] is not None} == want
    assert {g[0] for g in got} == {x[1] for x in a}


def test_flags_of_numbers_carry_only_names_and_references(spark):
    rows = [("d", 1, "101", 50.0, 100.0, 1), ("d", 1, "OFFICE", 52.0, 80.0, 2), ("d", 1, "102", 500.0, 100.0, 3), ("d", 1, "A1.2", 505.0, 120.0, 4),
            ("d", 1, "103", 900.0, 100.0, 5), ("d", 1, "7", 905.0, 90.0, 6), (None, 1, "104", 50.0, 100.0, 7)]
    items = spark.createDataFrame(rows, "doc string, page bigint, text string, cx double, y0 double, item bigint")
    flags = plans.stack_flags(items.filter("text RLIKE '^[0-9]+$'"), items, ["doc", "page"])
    assert {r.item: (r.room, r.bubble) for r in flags.collect()} == {1: (True, False), 3: (False, True), 5: (False, False), 6: (False, False)}
    assert "Join LeftOuter" in plan(flags)  # the numbers without a neighbour that counts need none


def test_lists_of_ids_are_folded_together_without_a_join(spark):
    read = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)], "doc bigint, tag string")
    printed = spark.createDataFrame([(1, "b"), (1, "c"), (2, None), (None, "z")], "doc bigint, tag string")
    got = locate.unconfirmed(read, printed, ["doc"])
    assert sorted((r.what, r.doc, r.tag) for r in got.filter("doc IS NOT NULL AND tag IS NOT NULL").collect()) == [("made up", 1, "a"), ("missed", 1, "c")]
    assert sorted(r.what for r in got.filter("doc IS NULL OR tag IS NULL").collect()) == ["made up", "missed", "missed"]
    assert "Join" not in plan(got)


def test_a_heading_is_split_once(spark):
    d = spark.createDataFrame([("DOOR DOOR DATA DOOR TYPE",), ("",), (None,)], "h string").select(text.without_group(F.col("h")).alias("p"))
    assert [r.p for r in d.collect()] == ["DOOR TYPE", "", None]
    assert plan(d).count("split(") == 1


def test_texts_are_moved_by_a_table_and_odd_ones_by_character(spark):
    texts = ["plain text", "naïve Ω", "line\nend\n", "euro €5", "\x00a", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    move = lambda t, by: None if t is None else "".join(chr(ord(c) + by) for c in t)
    up = d.select(fonts.shifted("t", "7", F.lit("".join(chr(ord(c) + 7) for c in fonts.PLAIN))).alias("m")).collect()
    assert [r.m for r in up] == [move(t, 7) for t in texts]
    low = d.filter("t IS NULL OR NOT t RLIKE '[\\\\x00-\\\\x1f]'").select("t", fonts.drawn_below("t", 29).alias("m")).collect()
    assert [r.m for r in low] == [move(r.t, -29) for r in low] and len(low) == 5


def test_spans_of_a_font_come_back_in_latin_and_other_letters(spark):
    texts = ["the door and frame of level two", "à côté de la porte", "price 5 € the door", None]
    d = spark.createDataFrame([(t,) for t in texts], "original string").withColumn("text", fonts.drawn_below("original", 29)).withColumn("lang", F.lit("x"))
    assert sorted(map(str, (r.text for r in fonts.repair(d, ["lang"]).collect()))) == sorted(map(str, texts))


def test_only_the_items_asked_for_are_scored(spark):
    rows = [(1, 1, 0.0, 0.0, True, False), (1, 2, 20.0, 5.0, False, True), (1, 3, 30.0, 0.0, False, False), (1, 4, 400.0, 0.0, True, False)]
    items = spark.createDataFrame(rows, "page bigint, item bigint, cx double, cy double, is_tag boolean, is_dim boolean")
    scores = lambda df: {r.item: (r.score, r.near) for r in df.collect()}
    assert scores(plans.company(items, ["page"])) == {1: (1, True), 2: (2, True), 3: (3, True), 4: (0, False)}
    assert scores(plans.company(items, ["page"], of="is_tag")) == {1: (1, True), 4: (0, False)}


def test_items_in_boxes_are_looked_up_once(spark):
    rows = [("d", 1, 10.0, 10.0, 20.0, 20.0, "in"), ("d", 1, 10.0, 10.0, 20.0, 20.0, "in"), ("d", 1, 250.0, 10.0, 270.0, 20.0, "over a cell's edge"), ("d", 1, 10.0, 90.0, 20.0, 130.0, "sticks out"),
            ("d", 2, 10.0, 10.0, 20.0, 20.0, "other page"), (None, 1, 10.0, 10.0, 20.0, 20.0, "no document"), ("d", 1, -5.0, -5.0, 2.0, 2.0, "left of it")]
    items = spark.createDataFrame(rows, "doc string, page bigint, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([("d", 1, 0.0, 0.0, 300.0, 100.0), ("d", 1, 0.0, 0.0, 50.0, 50.0)], "doc string, page bigint, bx0 double, by0 double, bx1 double, by1 double")
    left = plans.outside(items, boxes, ["doc", "page"])
    assert left.columns == items.columns
    assert sorted(r.text for r in left.collect()) == ["left of it", "no document", "other page", "sticks out"]
    assert plan(left).count("Join") == 1 and "Aggregate" not in plan(left)


def test_spans_printed_twice_are_dropped_without_a_fold(spark):
    rows = [("d", 1, 1, 10.0, 5.0, " a "), ("d", 1, 2, 10.1, 5.1, "a"), ("d", 1, 3, 10.6, 5.0, "a"), ("d", 1, 4, 10.0, 5.0, "b"), ("d", 2, 5, 10.0, 5.0, "a"), (None, 1, 6, 1.0, 1.0, "n"), (None, 1, 7, 1.0, 1.0, "n"), ("d", 1, 8, 9.0, 9.0, " ")]
    df = spark.createDataFrame(rows, "doc string, page bigint, pos bigint, x0 double, y0 double, text string").selectExpr("*", "x0 + 5 AS x1", "y0 + 5 AS y1", "8D AS size", "true AS horizontal")
    got = spans.text_items(df)
    assert sorted((r.doc or "", r.page, r.x0, r.text) for r in got.collect()) == [("", 1, 1.0, "n"), ("d", 1, 10.0, "a"), ("d", 1, 10.0, "b"), ("d", 1, 10.6, "a"), ("d", 2, 10.0, "a")]
    assert "Aggregate" not in plan(got)


def test_a_door_looks_as_far_as_four_tags(spark):
    rnd = random.Random(5)
    place = lambda s: (rnd.gauss(0, s), rnd.gauss(0, s))
    tags = [(1, i, f"S{i % 5}", *place(60)) for i in range(300)] + [(1, 1000 + i, f"S{i % 3}", 2.5, 2.5) for i in range(200)] + [(2, 5000, "S1", 150.0, 0.0), (2, 5001, "S2", 0.0, 220.0)]
    doors = [(1, i, *place(90)) for i in range(80)] + [(1, 500, 2.5, 2.5), (1, 500, 2.5, 2.5), (2, 600, 0.0, 0.0), (2, 601, 900.0, 0.0), (None, 602, 0.0, 0.0)]
    d = spark.createDataFrame(doors, "page bigint, id bigint, cx double, cy double")
    t = spark.createDataFrame(tags, "page bigint, tag_id bigint, symbol string, ox double, oy double")

    def plain(page, i):
        near = sorted((math.sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)), s, n) for p, j, x, y in doors if (p, j) == (page, i) for q, n, s, ox, oy in tags if q == p)
        near = [n for n in near if n[0] <= 200][:4]
        more = [n[1] for n in near[1:] if n[1] != near[0][1] and n[0] <= near[0][0] * 1.6]
        return near and (not more, near[0][0], list(dict.fromkeys([near[0][1], *more]))[:3])

    got = {(r.page, r.id): (r.decided, r.gap, r.candidates) for r in detections.choose_wall(d, t, ["page"], 10.0).collect()}
    assert got == {k: w for k in {x[:2] for x in doors} if (w := plain(*k))}
    far = {(r.page, r.id): r._far for r in spatial.reach_of(d, t, ["page"], 4, 200.0).collect()}
    assert far[1, 500] < 1 and far[2, 600] == far[2, 601] == 200.0


def test_readings_of_a_page_are_folded_side_by_side_or_in_rounds_alike(spark, monkeypatch):
    from mullion.operators import graph, tables

    rnd = random.Random(11)
    rows = [(p if p else None, f"t{t}", str(rnd.randint(1, 12)) if rnd.random() < 0.9 else "") for p in range(14) for t in range(7) for _ in range(rnd.randint(1, 6))]
    r = spark.createDataFrame(rows, "doc bigint, tbl string, door_tag string")
    tabs = r.groupBy("doc", "tbl").agg(F.count(F.lit(1)).alias("rows"))
    read = lambda: sorted(tuple(x) for x in tables.one_reading(tabs, r, ["doc"], ["tbl"], [-F.col("rows")]).fillna(-1).collect())
    monkeypatch.setattr(tables, "PAGE_ROWS", 0)
    rounds = read()
    monkeypatch.setattr(tables, "PAGE_ROWS", 22)
    assert read() == rounds
    monkeypatch.setattr(tables, "PAGE_ROWS", 4096)
    monkeypatch.setattr(graph, "first_fit", None)  # small pages need no rounds
    assert read() == rounds


def test_headings_are_looked_for_close_by_first(spark, monkeypatch):
    from mullion.operators import books

    word = lambda line, w, t, page=1: ("d", page, line, w, 40.0 * w, 40.0 * w + 30, t)
    rows = [word(0, 0, "Far"), word(30, 0, "$10.00"), word(5, 1, "Upper"), word(26, 1, "Nearer"), word(27, 1, "KX1234"), word(30, 1, "$11.00"), word(22, 2, "Edge"), word(30, 2, "$12.00"),
            word(21, 3, "Past"), word(30, 3, "$13.00"), word(30, 4, "$14.00"), word(500, 0, "$15.00"), word(99, 0, "Too far"), word(0, 5, "Other page", 2)]
    p = spark.createDataFrame(rows, "doc string, page bigint, line int, w int, x0 double, x1 double, text string")
    want = {(30, 0): "Far", (30, 1): "Nearer", (30, 2): "Edge", (30, 3): "Past", (30, 4): "", (500, 0): ""}
    steps = []
    monkeypatch.setattr(books, "cut", lambda df: steps.append(plan(df)) or df)
    assert {(r.line, r.w): r.heading for r in books.price_headings(p, ["doc", "page"]).collect()} == want
    assert "_b#" in steps[-1]  # the first look joins by blocks of lines


def test_tables_and_loose_tags_look_through_the_items_once(spark, monkeypatch):
    rows = [("d", 1, 10.0, 20.0 * i, 40.0, 20.0 * i + 8, str(100 + i), 8.0, i) for i in range(6)] + [("d", 1, 300.0, 20.0 * i, 340.0, 20.0 * i + 8, "OFFICE", 9.0, 50 + i) for i in range(3)] + [
        ("d", 1, 12.0, 150.0, 42.0, 158.0, "109", 8.0, 90), ("d", 1, 30.0, 150.0, 60.0, 158.0, "100", 8.0, 91), ("d", 1, 300.0, 47.0, 330.0, 55.0, "108", 8.0, 92)]
    items = spark.createDataFrame(rows, "doc string, page bigint, x0 double, y0 double, x1 double, y1 double, text string, size double, pos bigint")
    tags = items.filter("pos < 6 OR pos = 91").selectExpr("doc", "text AS tag").distinct()
    steps = []
    kept = locate.cut
    monkeypatch.setattr(locate, "cut", lambda df: steps.append(df.columns) or kept(df))
    loose = locate.tagged_but_unscheduled(items, tags, ["doc", "page"], ["doc"])
    assert [(r.pos, r.label, r.score) for r in loose.collect()] == [(90, "109", 2)]
    assert [("item" in s, "x1" in s) for s in steps] == [(False, False), (True, False)] and "shaped" in steps[1]
    steps.clear()
    box = locate.boxes_from_text(items.drop("size", "pos"), tags.selectExpr("doc", "1L AS page", "'T' AS table", "tag AS door_tag"), ["doc", "page"]).collect()
    assert [(r.left, r.top, r.bottom, r.row_height, r.limit) for r in box] == [(10.0, 0.0, 108.0, 20.0, None)]
    assert steps[0] == ["doc", "page", "table", "x0", "y0", "y1", "cy"]
