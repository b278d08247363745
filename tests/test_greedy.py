"""Distributed greedy steps against a plain loop on small random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from mullion.operators import books, graph, plans, prices, sheets


def test_first_fit_equals_the_loop(spark):
    rnd = random.Random(1)
    edges = {(b, a) for _ in range(120) for a, b in [sorted(rnd.sample(range(60), 2))]}
    kept = []
    for i in range(60):
        if not any((i, j) in edges for j in kept):
            kept.append(i)
    got = graph.first_fit(spark.range(60).select("id"), spark.createDataFrame(sorted(edges), "id long, rival long"))
    assert sorted(r.id for r in got.collect()) == kept


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_sheet_cover_covers_every_tag_and_follows_the_order(spark):
    rnd = random.Random(3)
    pairs = {(0, s, t) for s in range(8) for t in rnd.sample(range(30), rnd.randrange(2, 14))}
    on = {s: {t for _, x, t in pairs if x == s} for s in range(8)}
    order = sorted(on, key=lambda s: (-len(on[s]), s))
    kept, covered = [], set()
    for s in order:
        if len(on[s] - covered) >= len(on[s]) * 0.5:
            kept.append(s)
            covered |= on[s]
    left = set().union(*on.values()) - covered
    while left:
        s = max(on, key=lambda p: (len(on[p] & left), -p))
        kept.append(s)
        left -= on[s]
    got = sheets.sheets_worth_scanning(spark.createDataFrame(sorted(pairs), "doc long, sheet long, tag long"), ["doc"]).collect()
    assert sorted(r.sheet for r in got if r.step != "skipped") == sorted(kept)


def test_read_batches_follow_the_loop_and_hold_their_caps(spark):
    rnd = random.Random(4)
    products = [(f"p{i:02d}", i, sorted(rnd.sample(range(20), rnd.randrange(1, 4)))) for i in range(40)]
    batches = []
    for name, _, pages in products:
        home = next((b for b in batches if b[0] & set(pages) and len(b[1]) < 5 and len(b[0] | set(pages)) <= 6), None)
        if home is None:
            home = (set(), [])
            batches.append(home)
        home[0].update(pages)
        home[1].append(name)
    found = spark.createDataFrame([("m", n, i, p) for n, i, ps in products for p in ps], "maker string, product string, pos long, page long")
    got = {}
    for r in books.plan_calls(found, max_pages=6, max_products=5).collect():
        got.setdefault((r.piece, r.batch), set()).add(r["product"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(b[1]) for b in batches)


def test_one_arc_per_point_and_nobody_left_out_needlessly(spark):
    rnd = random.Random(5)
    points = [(0, i, rnd.uniform(0, 300), rnd.uniform(0, 300)) for i in range(25)]
    arcs = [(0, i, rnd.uniform(0, 300), rnd.uniform(0, 300), 25.0, 0.01) for i in range(25)]
    got = plans.assign_swings(spark.createDataFrame(points, "page long, point long, cx double, cy double"),
                              spark.createDataFrame(arcs, "page long, arc long, ox double, oy double, radius double, residual double"), ["page"], 60.0, 25.0).collect()
    near = {p: [a for _, a, x, y, _, _ in arcs if abs(x - px) <= 60 and abs(y - py) <= 60] for _, p, px, py in points}
    best: dict = {}

    def serve(p, seen):
        for a in near[p]:
            if a not in seen:
                seen.add(a)
                if a not in best or serve(best[a], seen):
                    best[a] = p
                    return True
        return False

    for p in near:
        serve(p, set())
    assert len({r.point for r in got}) == len({r.arc for r in got}) == len(got) == len(best)
    assert all(r.arc in near[r.point] for r in got)


@pytest.mark.parametrize("model, finish, size, status, price", [
    ("BB1168", "US26D", "4-1/2 x 4-1/2", "priced", 40.0),      # the finish by its other name
    ("BB1168", "", "4-1/2 x 4-1/2", "needs_review", None),     # no finish given
    ("BB1168", "630", "4.5 x 4.5", "not_found", None),         # a finish the book does not price
    ("BB1168", "626", "", "needs_review", None),               # priced in two sizes
    ("BB1168 NRP", "626", "5 x 4 1/2", "needs_review", 55.0),  # a word left over
    ("NO SUCH", "626", "", "not_found", None),
])
def test_quote(spark, model, finish, size, status, price):
    rows = [(1, "M", "BB1168", "BB1168", "base", "626", '4-1/2" x 4-1/2"', 40.0, 3), (2, "M", "BB1168", "BB1168", "base", "626", '5" x 4-1/2"', 55.0, 3)]
    book = spark.createDataFrame(rows, "id long, manufacturer string, model string, match_key string, kind string, finish string, size string, list_price double, pdf_page int")
    item = spark.createDataFrame([("x", "M", model, finish, size)], "product string, manufacturer string, model string, finish string, size string")
    got = prices.quote(item, book).first()
    assert (got.status, got.list_price) == (status, price)


def test_first_fit_follows_chains_by_doubling(spark, monkeypatch):
    from mullion.operators import graph

    rnd = random.Random(3)
    cases = {
        "chain": (1000, [(i, i - 1) for i in range(1, 1000)]),
        "two rivals each": (40, [(i, i - k) for i in range(40) for k in (1, 2) if i >= k]),
        "star": (300, [(i, 0) for i in range(1, 300)]),
        "random": (1500, [(i, rnd.randrange(i)) for i in range(1, 1500) for _ in range(rnd.randrange(4))]),
        "no conflict": (5, []),
    }
    rounds, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or write(df))
    for name, (n, conflicts) in cases.items():
        rounds.clear()
        got = {r.id for r in graph.first_fit(spark.range(n), spark.createDataFrame(conflicts, "id long, rival long")).collect()}
        kept, rivals = set(), {}
        for a, b in conflicts:
            rivals.setdefault(a, []).append(b)
        for i in range(n):
            if not any(r in kept for r in rivals.get(i, [])):
                kept.add(i)
        assert got == kept, name
        if name == "chain":
            assert len(rounds) <= 7


@pytest.mark.parametrize("seed, n, m, links", [(1, 60, 50, 150), (2, 80, 80, 130), (3, 30, 60, 40), (4, 1, 1, 0)])
def test_widest_matching_is_as_large_as_can_be(spark, seed, n, m, links):
    rnd = random.Random(seed)
    edges = sorted({(rnd.randrange(n), rnd.randrange(m)) for _ in range(links)})
    if seed == 3:
        edges += [(100 + i, 200 + i) for i in range(25)] + [(100 + i, 201 + i) for i in range(25)]  # a long alternating path
    want, holder = {}, {}
    for a, b in edges:
        want.setdefault(a, []).append(b)

    def claim(a, asked):
        for b in want[a]:
            if b not in asked:
                asked.add(b)
                if b not in holder or claim(holder[b], asked):
                    holder[b] = a
                    return True
        return False

    size = sum(claim(a, set()) for a in want)
    df = spark.createDataFrame([(a, b, a, float((a * 7 + b * 3) % 11) + b / 1000) for a, b in edges], "a long, b long, turn long, liking double")
    got = [(r.a, r.b) for r in graph.widest_matching(df).collect()]
    assert set(got) <= set(edges) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == size


def test_widest_matching_never_plans_a_whole_path_at_once(spark, monkeypatch):
    from mullion.operators import graph

    # Every a but the first holds the b that the one after it would like; only moving all of them serves the last.
    n = 12
    edges = [(i, i, i, 0.0) for i in range(n)] + [(i, i + 1, i, 1.0) for i in range(n)] + [(n, 0, n, 0.0)]
    joins, write = [], graph.cut

    def counted(df):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return write(df)

    monkeypatch.setattr(graph, "cut", counted)
    got = {r.a: r.b for r in graph.widest_matching(spark.createDataFrame(edges, "a long, b long, turn long, liking double")).collect()}
    assert got == {i: i + 1 for i in range(n)} | {n: 0}
    assert max(joins) <= 4
