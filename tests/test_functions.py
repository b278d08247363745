"""Worked examples of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from mullion.functions import sizes, text


SCALARS = [
    (text.match_key, "9948EO-F", "9948EOF"), (text.match_key, "9948 eo f", "9948EOF"),
    (sizes.to_feet_inches, "914 mm", "3' - 0\""), (sizes.to_feet_inches, "2032 mm", "6' - 8\""),
    (sizes.to_feet_inches, "44 mm", '1 3/4"'), (sizes.to_feet_inches, "35 mm", '1 3/8"'),
    (sizes.to_feet_inches, "207M", "679' - 1 5/8\""),
    (sizes.bare_mm, "2135H", "7' - 0\""), (sizes.bare_mm, "299", None),
    (sizes.inches, "4-1/2", 4.5), (sizes.inches, "4 1/2", 4.5), (sizes.inches, "3/4", 0.75),
    (sizes.dimensions, "4½ x 4½", [4.5, 4.5]), (sizes.device_length, '48"', "4'"), (sizes.device_length, '42"', None),
    (sizes.device_length, "4'-0\"", "4'"), (sizes.device_length, "3'-6\"", None),
    (sizes.door_width, "3'-0\"", 36.0), (sizes.door_width, '36"', 36.0), (sizes.door_width, "", None),
    (text.expand_product, "[98/99]48", ["9848", "9948"]), (text.expand_product, "XP[98/99]", ["XP98", "XP99"]),
    (text.join_split_mark, "105 B", "105B"), (text.join_split_mark, "101 HMX", "101 HMX"),
    (text.listed_tags, "104,105,106,107,108,", ["104", "105", "106", "107", "108"]),
    (text.listed_tags, "101,102,103,109 110,111,112,113", ["101", "102", "103", "109", "110", "111", "112", "113"]),
    (text.listed_tags, "105 B", []), (text.listed_tags, "STAIR 1", []),
    (text.is_floor_plan, "COMPOSITE FLOOR PLAN - LEVEL 1", True),
    (text.is_floor_plan, "FLOOR PLAN AND REFLECTED CEILING PLAN", True),
    (text.is_floor_plan, "LEVEL 2 REFLECTED CEILING PLAN", False), (text.is_floor_plan, "SPECIALIZED PLANNING", False),
    (text.is_floor_plan, "FLOOR & LIGHTING PLAN", True), (text.is_floor_plan, "FURNITURE PLAN", False),
    (text.is_enlargement, "ENLARGED FLOOR PLAN PART 'A'", False), (text.is_enlargement, "ENLARGED RESTROOM PLAN", True),
    (text.level_of, "LEVEL 02 FLOOR PLAN", "LEVEL 2"), (text.level_of, "FIRST FLOOR PLAN PHASE II", "LEVEL 1 PHASE II"),
    (text.level_of, "GROUND FLOOR", "GROUND"), (text.level_of, "MEZZ PLAN", "MEZZANINE"),
    (text.rating, "ONE 1-HOUR WALL", "1 HR"), (text.finishes_in, "689 or 695", ["689", "695"]),
    (text.map_headers, ["FRAME FINISH", "FINISH", "HARDWARE TYPE", "DOOR SIZE WIDTH", "FR. TYPE", "MATERIAL", "MATERIAL"],
     ["frame_finish", "door_finish", "hw_set", "door_width", "frame_type", "door_material", "frame_material"]),
    (text.map_headers, ["SIZE W x H W", "WALL THICKNESS", "ROOM NO.", "DOOR DESIGN MATERIAL"],
     ["door_width", "", "door_tag", "door_material"]),
]


def test_scalars(spark):
    """All cases in one job: one column per case."""
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    base = spark.range(1).select(*[F.when(F.col("id") >= 0, lit(v)).alias(f"v{i}") for i, (_, v, _) in enumerate(SCALARS)])
    row = base.select(*[fn(F.col(f"v{i}")).alias(f"c{i}") for i, (fn, _, _) in enumerate(SCALARS)]).first()
    wrong = [(fn.__name__, v, want, row[i]) for i, (fn, v, want) in enumerate(SCALARS) if row[i] != want]
    assert not wrong


@pytest.mark.parametrize("value, width, want", [
    ('190S 10" x 34"', None, 3.40), ('190S x B4E x 10 x 34 in', None, 3.40), ('190S 10" x 1" LDW - 23"', None, 2.40),
    ('190S 10" x 2" LDW', 36.0, 3.40), ('190S 10" x 2" LDW', None, None), ('8400 4" X 1" LOW', 36.0, 1.44),
    ('4" x 1"', None, None),
])
def test_plate_units(spark, value, width, want):
    assert spark.createDataFrame([(value, width)], "t string, w double").select(
        sizes.plate_units(F.col("t"), F.col("w")).alias("r")).first().r == want


@pytest.mark.parametrize("value, width, want", [
    ("726 x LAR - 20'", None, 20.0), ("488S @ HEAD [19 LF]", None, 19.0), ("425 x 36 in", None, 3.0),
    ("160SA x 36 x 84 in", None, 17.0), ("413S x LAR", 36.0, 3.0), ("413S x LAR", None, None), ("425 x 31 in", None, None),
])
def test_length_units(spark, value, width, want):
    assert spark.createDataFrame([(value, width)], "t string, w double").select(
        sizes.length_units(F.col("t"), F.col("w")).alias("r")).first().r == want
