"""The interval join against all pairs."""

import random

from mullion.operators.spatial import points_in_intervals


def test_points_in_intervals_of_all_widths(spark):
    rnd = random.Random(5)
    points = [(rnd.randrange(3), i, rnd.choice([rnd.uniform(-50, 900), float(rnd.randrange(-3, 12))])) for i in range(300)]
    spans = [(rnd.randrange(3), i, lo := rnd.choice([rnd.uniform(-60, 800), float(rnd.randrange(-3, 12))]), lo + rnd.choice([0.0, 0.5, 1.0, 7.0, 64.0, 700.0, -1.0])) for i in range(120)]
    got = points_in_intervals(spark.createDataFrame(points, "k int, p int, at double"), spark.createDataFrame(spans, "k int, s int, lo double, hi double"), ["k"], "at", "lo", "hi")
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for k, p, at in points for j, s, lo, hi in spans if j == k and lo <= at <= hi)
