"""Folds of a line, page or sheet share one shuffle and give what the two-level folds give."""

import random

from mullion.operators import finder, pages, sequence as seq, tables


def shuffles(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stitching_shuffles_once_and_leaves_out_pages_without_a_name(spark):
    rows = [(k, 40.0 * w, y, 40.0 * w + 38 - 30 * (w % 3 == 2), y + 10, f"t{w}", 8.0, True) for k in (1, None) for y in (12.0, 700.0) for w in range(6)]
    items = spark.createDataFrame(rows, "page bigint, x0 double, y0 double, x1 double, y1 double, text string, size double, horizontal boolean")
    got = pages.stitch_lines(items, ["page"])
    assert sorted((r.page, r.y0, r.text) for r in got.collect()) == [(1, y, t) for y in (12.0, 700.0) for t in ("t0 t1 t2", "t3 t4 t5")]
    assert shuffles(got) == 1 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_folds_without_a_bucket_give_the_same(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, None]), i, rnd.choice([None, rnd.uniform(0, 900)]) if i % 9 == 0 else rnd.uniform(0, 900)) for i in range(300)]
    d = spark.createDataFrame(rows, "k bigint, id bigint, v double").withColumn("e", seq.F.col("v") + 7)
    f = lambda df: sorted(map(tuple, df.collect()))
    aggs = {"s": ("sum", seq.F.col("id")), "l": ("last", seq.F.col("id")), "m": ("max", seq.F.col("id"))}
    for inclusive in (True, False):
        wide = seq.running(d, ["k"], seq.F.floor(seq.F.col("v") / 64), ["v", "id"], aggs, inclusive).select("k", "id", "s", "m", seq.F.coalesce("l", seq.F.lit(-1)), seq.F.coalesce("m", seq.F.lit(-1)))
        flat = seq.running(d, ["k"], None, ["v", "id"], aggs, inclusive).select("k", "id", "s", "m", seq.F.coalesce("l", seq.F.lit(-1)), seq.F.coalesce("m", seq.F.lit(-1)))
        assert f(wide.drop("m")) == f(flat.drop("m"))
    one, two = (seq.anchored(d, ["k"], "v", 4.0, w).select("k", "id", "v", "cluster") for w in (64.0, None))
    assert f(one) == f(two) and shuffles(two) == 1
    one, two = (seq.coverage(d, ["k"], "v", "e", seq.F.lit(0.0), seq.F.lit(800.0), w) for w in (64.0, None))
    assert [(k, round(c, 6)) for k, c in f(one)] == [(k, round(c, 6)) for k, c in f(two)]


def counted(monkeypatch, module):
    """Steps of ``module`` written to the checkpoint folder from here on."""
    done, plain = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: done.append(1) or plain(df))
    return done


def test_ruled_grids_write_two_steps_and_headings_look_no_rules_up_by_cell(spark, monkeypatch):
    rules = [(1, "v", 80.0 * i, 100.0, 180.0) for i in range(7)] + [(1, "h", 100.0 + 20 * i, 0.0, 480.0) for i in range(5)] + [(None, "v", 3.0, 100.0, 180.0)]
    rulings = spark.createDataFrame(rules, "doc bigint, axis string, pos double, start double, end double")
    headers = spark.createDataFrame([(1, 6.0, 105.0, 436.0, 115.0, 6.0)], "doc bigint, hx0 double, hy0 double, hx1 double, hy1 double, tag_x double")
    steps, folds = counted(monkeypatch, tables), counted(monkeypatch, seq)
    grid = tables.ruled_grid(headers, rulings, ["doc"])
    assert [(r.left, r.right, r.header_bottom, r.bounds, r.row_bounds) for r in grid.collect()] == [(0.0, 480.0, 120.0, [80.0 * i for i in range(7)], [120.0, 140.0, 160.0, 180.0])]
    assert (len(steps), len(folds)) == (2, 0)
    items = [(1, 80.0 * i + 6, 105.0, 80.0 * i + 36, 115.0, f"H{i}", True) for i in range(6)] + [(1, 100.0, 106.0, 101.0, None, "LOST", True)]
    got = tables.header_texts(spark.createDataFrame(items, "doc bigint, x0 double, y0 double, x1 double, y1 double, text string, horizontal boolean"), grid, ["doc"], rulings)
    assert sorted((r.col, r.header) for r in got.collect()) == [(i, f"H{i}") for i in range(6)]
    assert "_gx" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_banded_columns_meet_their_headers_in_the_only_join(spark):
    items = spark.createDataFrame([(1, 80.0 * c + (r == 2), 20.0 * r, 80.0 * c + 30, 20.0 * r + 8, True) for r in range(1, 5) for c in range(4)] + [(1, 255.0, 30.0, 270.0, 38.0, True)],
                                  "doc bigint, x0 double, y0 double, x1 double, y1 double, horizontal boolean")
    headers = spark.createDataFrame([(1, 0.0, 0.0, 270.0, 10.0)], "doc bigint, hx0 double, hy0 double, hx1 double, hy1 double")
    got = tables.banded_grid(items, headers, ["doc"])
    assert [r.bounds for r in got.collect()] == [[-3.0, 80.0, 160.0, 240.0, 330.0]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_bands_are_split_in_one_written_step(spark, monkeypatch):
    rows = [(k, x, 12.0 * n, x + 20, 12.0 * n + 8, w, True) for k in (1, None) for n in range(3) for x, w in ((0.0, "WIDTH"), (40.0, "TYPE"), (900.0, "REMARKS"))]
    items = spark.createDataFrame(rows, "page bigint, x0 double, y0 double, x1 double, y1 double, text string, horizontal boolean")
    steps, splits, folds = (counted(monkeypatch, m) for m in (finder, pages, seq))
    bands = finder.scored_bands(items, ["page"]).collect()
    assert (len(steps), len(splits), len(folds)) == (1, 0, 0)
    assert {(r.page, r.idx, r.gap_part, r.n_words) for r in bands if r.step == 0} == {(1, i, g, 2 - g) for i in (1, 2, 3) for g in (0, 1)}


def test_body_top_keeps_of_the_body_only_what_the_lines_ask_for(spark):
    from pyspark.sql import functions as F

    from mullion.operators import tables

    values = spark.range(778).select(F.lit(1).alias("t"), F.lit(0).alias("col"), F.format_string("%04d", "id").alias("text")).unionByName(
        spark.createDataFrame([(1, 1, "HM"), (1, None, "A"), (1, 1, None)], "t int, col int, text string"))
    lines = spark.createDataFrame([(1, 1, 90.0, 98.0, 0, "9999"), (1, 1, 90.0, 98.0, 1, "ab"), (1, 2, 70.0, 78.0, 0, "0007"), (1, 2, 70.0, 78.0, 1, "WORDS"),
                                   (1, 3, 50.0, 58.0, 0, "NO."), (1, 3, 50.0, 58.0, 1, None)], "t int, line int, y0 double, y1 double, col int, text string")
    top = tables.body_top(lines, values, ["t"])
    assert [tuple(r) for r in top.collect()] == [(1, 69.0, 2)]
    # Going up from the body's cells, they meet what was asked for before anything gathers them.
    plan = top._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: next(i for i, c in enumerate(x) if c.isalnum())
    at = next(i for i, x in enumerate(plan) if "Range (0, 778" in x)
    above, d = [], depth(plan[at])
    for x in reversed(plan[:at]):
        if depth(x) < d:
            d = depth(x)
            above.append(x[d:].split()[0])
    assert next(x for x in above if x in ("Join", "Aggregate")) == "Join"


def test_rows_of_a_table_are_stitched_in_one_shuffle_without_a_width(spark):
    from mullion.operators import rows

    data = [(k, 20.0 * i + 300 * (i > 7), [f"1{i:02d}" if i % 3 else "", "a", "" if i % 3 else "more"], bool(i % 3)) for k in ("a", "b") for i in range(12)]
    lines = spark.createDataFrame(data, "k string, y double, cells array<string>, has_tag boolean")
    plain, ranged = rows.stitch(lines, ["k"], None, None), rows.stitch(lines, ["k"], 64.0, None)
    key = lambda df: sorted((r.k, r.row_no, r.y, r.y_end, tuple(r.cells)) for r in df.collect())
    assert key(plain) == key(ranged)
    assert shuffles(plain) == 1 < shuffles(ranged)
