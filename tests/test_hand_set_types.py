"""Types set by hand are carried over where the page is one of the keys."""

from mullion.operators import detections as det, merges as mg

NEW = "id bigint, page bigint, cx double, cy double, tag string, kind string"
TYPED = "typed_id bigint, page bigint, cx double, cy double, tag string, kind string"


def test_types_are_carried_by_tag_and_by_nearness(spark):
    new = spark.createDataFrame([(1, 1, 0.0, 0.0, "A", "single"), (2, 1, 50.0, 50.0, "", "single"), (3, 2, 50.0, 50.0, "", "single"), (4, 1, 90.0, 50.0, "", "single")], NEW)
    typed = spark.createDataFrame([(7, 1, 900.0, 0.0, "A", "K1"), (8, 1, 900.0, 0.0, "A", "K2"), (9, 1, 60.0, 45.0, "", "K3"), (6, 1, 55.0, 45.0, "", "K4")], TYPED)
    got = det.keep_types(new, typed, ["page"], "page", 10.0)
    assert {r.id: (r.kind, r.kind_by_hand) for r in got.collect()} == {1: ("K2", True), 2: ("K4", True), 3: ("single", False), 4: ("single", False)}
    other = det.keep_types(new.withColumnRenamed("page", "sheet").selectExpr("*", "1 AS doc"), typed.withColumnRenamed("page", "sheet").selectExpr("*", "1 AS doc"), ["doc"], "sheet", 10.0)
    assert {r.id: r.kind for r in other.collect()} == {1: "K2", 2: "K4", 3: "single", 4: "single"}


def test_an_audit_is_saved_with_the_types_set_by_hand(spark):
    wide = ["id", "page", "cx", "cy", "cx - 5 AS x0", "cy - 5 AS y0", "cx + 5 AS x1", "cy + 5 AS y1", "tag", "kind"]
    found = [(1, 1, 0.0, 0.0, "A", "single"), (2, 1, 9.0, 0.0, "A", "single"), (3, 1, 50.0, 50.0, "", "single"), (4, 3, 0.0, 0.0, "B", "single"), (5, 1, 200.0, 0.0, "D", "single")]
    dead = spark.createDataFrame([(9, 1, 500.0, 0.0, "D", "")], NEW).selectExpr(*wide).drop("kind")
    typed = spark.createDataFrame([(7, 1, 900.0, 0.0, "A", "K1"), (8, 1, 52.0, 50.0, "", "K2")], TYPED)
    sheets = spark.createDataFrame([(1,), (2,)], "page bigint")
    out = mg.save_audit(spark.createDataFrame(found, NEW).selectExpr(*wide), sheets, dead, typed, ["page"], 10.0)
    assert {r.id: r.kind for r in out.collect()} == {1: "K1", 3: "K2"}
