"""The company of items is that of a plain loop, and items are moved once for it."""

import random

from mullion.operators import plans

ITEM = "page bigint, item bigint, cx double, cy double, is_tag boolean, is_dim boolean"


def test_company_is_that_of_a_plain_loop(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2, None]) if i % 7 == 0 else 1, i, rnd.uniform(-300, 600), rnd.uniform(-200, 400), rnd.random() < 0.2, None if rnd.random() < 0.1 else rnd.random() < 0.1) for i in range(260)]
    rows += rows[:40] + [(1, 900, None, 5.0, True, False), (1, None, 20.0, 5.0, True, False)]

    def told(r):
        near = [o for o in rows if (o[4] or o[5]) and r[0] is not None and r[0] == o[0] and None not in (r[1], o[1], r[2], o[2]) and r[1] != o[1] and abs(r[2] - o[2]) <= 45 and abs(r[3] - o[3]) <= 28]
        t, d = ([o[k] for o in near if o[k] is not None] for k in (4, 5))
        return (2 * max(t) + max(d), True) if t and d else (0, False)

    d = spark.createDataFrame(rows, ITEM)
    got = plans.company(d, ["page"])
    assert got.columns == [*d.columns, "score", "near"]
    show = lambda rs: sorted(rs, key=repr)
    assert show((r.page, r.item, r.score, r.near) for r in got.collect()) == show((r[0], r[1], *told(r)) for r in rows)
    some = plans.company(d, ["page"], of="is_tag")
    assert show((r.page, r.item, r.score, r.near) for r in some.collect()) == show((r[0], r[1], *told(r)) for r in rows if r[4])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
