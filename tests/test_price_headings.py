"""Headings of prices on a page of any length."""

import random

from mullion.operators import books

PIECE = "doc string, page bigint, line int, w int, x0 double, x1 double, text string"


def by_hand(rows):
    """A plain loop over the lines above each price."""
    out = []
    for d, p, line, w, x0, x1, t in rows:
        if not (t or "").startswith("$"):
            continue
        found = ""
        xcs = [(a[4] + a[5]) / 2 for a in rows if a[:4] == (d, p, line, w) and (a[6] or "").startswith("$")]
        for up in sorted({r[2] for r in rows if r[:2] == (d, p) and r[2] is not None and r[2] < line}, reverse=True) if None not in (d, p, line, w) else []:
            here = [r for r in rows if r[:3] == (d, p, up)]
            if any((r[6] or "").startswith("$") for r in here):
                continue
            over = sorted((r[4], r[6]) for r in here for xc in xcs if r[4] - 4 <= xc <= r[5] + 4)
            h = " ".join(t for _, t in over)
            if over and not (len(over) == 1 and h.startswith("KX")):
                found = h
                break
        out.append((d, p, line, w, found))
    return sorted(out, key=repr)


def test_a_heading_stands_any_number_of_lines_above_its_price(spark):
    word = lambda line, w, t, page=1: ("d", page, line, w, 40.0 * w, 40.0 * w + 30, t)
    rows = [word(99, 0, "Far"), word(500, 0, "$15.00"), word(2500, 0, "$16.00"), word(120, 0, "KX1234"), word(700, 1, "$17.00"), word(0, 5, "Other page", 2)]
    p = spark.createDataFrame(rows, PIECE)
    got = books.price_headings(p, ["doc", "page"], most=None)
    assert {(r.line, r.w): r.heading for r in got.collect()} == {(500, 0): "Far", (2500, 0): "Far", (700, 1): ""}


def test_headings_without_a_limit_are_those_of_a_plain_loop(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(420):
        kind, w = rnd.random(), rnd.randint(0, 6)
        t = f"${rnd.randint(1, 9)}.00" if kind < 0.2 else f"KX{rnd.randint(100, 199)}" if kind < 0.5 else rnd.choice(["Size", "Finish", "Each"])
        rows.append((rnd.choice(["a", "b", None]) if rnd.random() < 0.1 else "a", rnd.choice([1, 2]), rnd.randint(0, 60), w, 30.0 * w + rnd.choice([0, 3, 11]), 30.0 * w + rnd.choice([20, 31, 60]), t))
    rows += [r for r in rows[:60]]  # rows that come twice
    got = books.price_headings(spark.createDataFrame(rows, PIECE), ["doc", "page"], most=None).select("doc", "page", "line", "w", "heading")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_a_page_is_dealt_once_for_its_headings(spark):
    p = spark.createDataFrame([("d", 1, 0, 0, 0.0, 30.0, "Size"), ("d", 1, 3, 0, 0.0, 30.0, "$1.00")], PIECE)
    got = books.price_headings(p, ["doc", "page"], most=None)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
