"""The stop rule of stitched rows, and counting what came before and lower, against plain loops."""

import random

from mullion.operators import rows, sequence as seq


def test_ranked_before_over_many_stretches(spark):
    rnd = random.Random(4)
    points = [(k, at, float(rnd.choice([3, 5, 5, 5, rnd.random() * 40]))) for k, n in ((0, 3000), (1, 700), (2, 3)) for at in range(n)]
    asks = [(k, f"{k}/{at}", at, float(rnd.choice([5, rnd.random() * 40]))) for k, at, _ in points if at % 7 == 0]
    got = seq.ranked_before(spark.createDataFrame(points, "k int, at int, value double"), spark.createDataFrame(asks, "k int, id string, at int, value double"), ["k"], stretch=16)
    by = {}
    for k, at, v in points:
        by.setdefault(k, []).append((at, v))
    assert {r.id: r.below for r in got.collect()} == {i: sum(a < at and w < v for a, w in by[k]) for k, i, at, v in asks}


def plain(lines):
    """Rows of one table as (first y, last y): the reading line by line with its list of gaps."""
    gaps, prev, out = [], None, []
    for y, cells, tagged in lines:
        if out and gaps and y - prev > sorted(gaps)[len(gaps) // 2] * 4:
            break
        if out and not tagged and sum(c != "" for c in cells) <= 2:
            out[-1][1] = y
        else:
            out.append([y, y])
            if prev is not None:
                gaps.append(y - prev)
            prev = y
    return [tuple(o) for o in out]


def test_tables_end_at_a_wide_gap(spark):
    rnd = random.Random(2)
    step = {"even": lambda i: 20 + rnd.random(), "wider": lambda i: 1 + i * 0.01, "wild": lambda i: rnd.expovariate(1), "late": lambda i: 300.0 if i == 1500 else 10 + rnd.random(), "equal": lambda i: 20.5 if i == 600 else 5.0}
    want, data = {}, []
    for kind, n in (("even", 2500), ("wider", 1200), ("wild", 80), ("late", 1800), ("equal", 700), ("one", 1)):
        y, lines = 0.0, []
        for i in range(n):
            y += step.get(kind, lambda i: 1.0)(i)
            lines.append((y, ["x", "", ""] if rnd.random() < 0.8 else ["a", "b", "c"], rnd.random() < 0.7))
        want[kind] = plain(lines)
        data += [(kind, *line) for line in lines]
    rnd.shuffle(data)
    got = {}
    df = rows.stitch(spark.createDataFrame(data, "k string, y double, cells array<string>, has_tag boolean"), ["k"], 256.0)
    for r in df.collect():
        got.setdefault(r.k, []).append((r.y, r.y_end))
    assert {k: sorted(v) for k, v in got.items()} == want
