"""Removal of tables, accepted arcs and repaired text on known answers."""

import math

from pyspark.sql import functions as F

from mullion.operators import detections as det, fonts, merges as mg, tables as tb

SCHEDULES = "document_id int, schedule_id string, page int, title string, row_count bigint"
DOORS = "document_id int, schedule_id string, door_tag string, row_index bigint, source string"


def test_removal_by_name_by_order_and_refused(spark):
    # 1 names its tables; 2 names one for all (the longer table of a page comes first); 3 does not add up; 4 has one table.
    s = spark.createDataFrame([(1, "a", 5, "Doors", 2), (1, "b", 6, None, 2), (2, "a", 5, "Windows", 1), (2, "b", 5, "Doors", 2), (3, "a", 5, "x", 1), (3, "b", 6, "y", 5), (4, "a", 5, "z", 2)], SCHEDULES)
    doors = [(1, "a", "T1", 0, "schedule"), (1, "a", "T2", 1, "schedule"), (1, "b", "T2", 2, "schedule"), (1, None, "T9", 0, "plan"),
             (2, "a", "T1", 0, "schedule"), (2, "a", "T2", 1, "schedule"), (2, "a", "T3", 2, "schedule"), (2, None, "T3", 2, "plan"),
             (3, "a", "T1", 0, "schedule"), (3, "a", "T2", 1, "schedule"), (4, "a", "T1", 0, "schedule"), (4, "a", None, 1, "schedule")]
    boxes = [(1, "T1", False), (1, "T2", False), (2, "T1", True), (2, "T2", False), (2, "T3", False), (3, "T1", False), (4, "T1", True), (4, "T1", False), (4, None, False)]
    gone = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "a"), (4, "none"), (9, "a")], "document_id int, schedule_id string")
    out = mg.remove_schedules(s, spark.createDataFrame(doors, DOORS), spark.createDataFrame(boxes, "document_id int, door_tag string, by_hand boolean"), gone)
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert got(out.doors) == sorted([d for d in doors if d not in (doors[0], doors[1], doors[4], doors[5], doors[10], doors[11])], key=repr)
    assert got(out.boxes) == sorted([(1, "T2", False), (2, "T1", True), (2, "T3", False), (3, "T1", False), (4, "T1", True), (4, None, False)], key=repr)
    assert got(out.removed) == [(1, 5, "Doors"), (2, 5, "Doors"), (4, 5, "z")]
    assert got(out.hand_placed) == [(2, "T1"), (4, "T1")] and got(out.refused) == [(3, "a")]
    assert got(out.schedules.select("document_id", "schedule_id")) == [(1, "b"), (2, "a"), (3, "a"), (3, "b")]
    again = spark.createDataFrame([(1, "n1", 5, " DOORS ", 2), (1, "n2", 7, "Doors", 2), (2, "n3", 5, "windows", 1)], SCHEDULES)
    assert got(tb.leave_out_removed(again, out.removed, ["document_id"]).select("schedule_id")) == [("n2",), ("n3",)]


def test_only_swings_are_accepted_and_vouch(spark):
    def arc(chain, lo, hi, r=50.0, off=0.0, n=12):
        return [(chain, (r + off * (-1) ** k) * math.cos(a), (r + off * (-1) ** k) * math.sin(a)) for k in range(n) for a in [math.radians(lo + (hi - lo) * k / (n - 1))]]

    points = arc(1, 0, 90) + arc(2, 0, 40) + arc(3, -70, 70) + arc(4, 10, 100, off=0.5) + arc(5, 0, 90, r=80) + arc(6, 0, 90, n=3) + [(7, float(i), float(i)) for i in range(9)]
    fits = det.fit_circles(spark.createDataFrame(points, "chain int, x double, y double"), ["chain"])
    assert sorted(r.chain for r in det.accept_arcs(fits, F.lit(50.0)).collect()) == [1]
    arcs = det.accept_arcs(fits, F.lit(None).cast("double")).select(F.lit("d").alias("doc"), F.col("chain").alias("id"))
    assert sorted(r.id for r in arcs.collect()) == [1, 5]
    seen = [("d", 1, "", "", False), ("d", 2, "", "", False), ("d", 3, "T3", "", False), ("d", 4, "T4", "", True), ("d", 5, None, "", False), ("d", 6, "T4", "", False)]
    out = det.confirm(spark.createDataFrame(seen, "doc string, id int, tag string, shape string, beside boolean"), arcs, ["doc"])
    assert sorted((r.id, r.shown) for r in out.collect()) == [(1, True), (2, False), (3, True), (4, True), (5, True)]


def test_repair_moves_unreadable_spans_only(spark):
    low = lambda s: "".join(chr(ord(c) - 29) for c in s)
    spans = [("f", low("FLOOR PLAN – ĀB XYZZY 1 OF THE SECOND LEVEL")), ("f", low("A 806")), ("f", "SOCIAL"), ("g", "READABLE TEXT WITH ONE \x07 BULLET"), (None, "\x03"), ("h", None), ("f", "")]
    out = fonts.repair(spark.createDataFrame(spans, "font string, text string"), ["font"])
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([("f", "FLOOR PLAN – ĀB XYZZY 1 OF THE SECOND LEVEL"), ("f", "A 806"), ("f", "SOCIAL"), *spans[3:]], key=repr)
