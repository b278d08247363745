"""Sinks: tables, nested exports, the master sheet and report folders."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from mullion.functions import text  # noqa: F401  (re-exported for callers)


def write_table(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet table; with ``partition_by`` only the partitions present in ``df`` are replaced."""
    path = os.path.join(folder, f"{name}.parquet")
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def write_report(sheets: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder per report sheet; the aggregates behind them are small."""
    out = {}
    for name, df in sheets.items():
        out[name] = os.path.join(folder, name.replace(" ", "_"))
        df.write.mode("overwrite").option("header", True).csv(out[name])
    return out


def export_project(docs: DataFrame, doors: DataFrame, sheets: DataFrame, detections: DataFrame) -> DataFrame:
    """Active documents with their doors by row index, sheets by page and detections nested."""
    def nest(df: DataFrame, order: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("document_id", order)]
        return df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))

    j = docs.filter("status = 'active'").withColumnRenamed("id", "document_id")
    for df, order, name in ((doors, "row_index", "doors"), (sheets, "page", "sheets"), (detections, "id", "detections")):
        j = j.join(nest(df, order, name), "document_id", "left")
    return j


def stored_document(docs: DataFrame, doors: DataFrame, pages: DataFrame, detections: DataFrame, suppressed: DataFrame, jobs: DataFrame,
                    primary_only: bool = False) -> DataFrame:
    """Whole read-back of a document: corrected doors, every page, detections, suppressed count and plan status.

    ``doors`` are already corrected; ``detections`` are measured and hand-placed together.
    """
    from mullion.operators.overlay import latest

    det = detections.filter("is_primary") if primary_only else detections
    base = export_project(docs.withColumn("status", F.lit("active")), doors, pages, det)
    n = suppressed.groupBy("document_id").agg(F.count(F.lit(1)).alias("suppressed"))
    job = latest(jobs.filter("kind = 'plan'"), ["document_id"], ["updated_at", "id"]).select("document_id", F.col("status").alias("plan_status"))
    return base.join(n, "document_id", "left").join(job, "document_id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(0)))


# The master sheet's columns in order, the fields printed as they are, and the keys looked for in extra.
MASTER_COLUMNS = [
    "DOOR TAG", "BUILDING TAG", "BUILDING LOCATION", "DOOR LOCATION", "QUANTITY", "HAND OF OPENINGS", "DOOR OPERATION", "LEAF COUNT",
    "INTERIOR/EXTERIOR", "EXCLUDE REASON", "WIDTH", "HEIGHT", "THICKNESS", "FIRE RATING", "DOOR MATERIAL", "DOOR ELEVATION TYPE", "DOOR CORE",
    "DOOR FACE", "DOOR EDGE", "DOOR GUAGE", "DOOR FINISH", "STC RATING", "DOOR UNDERCUT", "DOOR INCLUDE/EXCLUDE", "FRAME MATERIAL", "WALL TYPE",
    "THROAT THICKNESS", "FRAME ANCHOR", "BASE ANCHOR", "NO OF ANCHOR", "FRAME PROFILE", "FRAME ELEVATION TYPE", "FRAME ASSEMBLY", "FRAME GUAGE",
    "FRAME FINISH", "PREHUNG", "FRAME HEAD", "CASING", "FRAME INCLUDE/EXCLUDE", "HARDWARE SET", "HARDWARE INCLUDE/EXCLUDE",
]
DIRECT = {
    "DOOR TAG": "door_tag", "WIDTH": "door_width", "HEIGHT": "door_height", "FIRE RATING": "fire_rating", "DOOR MATERIAL": "door_material",
    "DOOR ELEVATION TYPE": "door_type", "DOOR FINISH": "door_finish", "FRAME MATERIAL": "frame_material", "FRAME FINISH": "frame_finish",
    "HARDWARE SET": "hw_set",
}
FROM_EXTRA = {
    "THICKNESS": ["thk", "door_thickness", "thickness", "panel_thk", "door_as_applicable_thk"], "STC RATING": ["stc_rating"],
    "FRAME ELEVATION TYPE": ["frame_type"], "FRAME GUAGE": ["frame_gauge", "gauge"],
    "FRAME HEAD": ["detail_reference_head", "head", "frame_head_detail"], "WALL TYPE": ["wall_type"], "DOOR GUAGE": ["door_gauge"],
}
OWN_FIELD = {"THICKNESS": "door_thickness", "FRAME ELEVATION TYPE": "frame_type"}


def master_sheet(doors: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 41 columns of the master sheet, '' where unknown; door columns a frame lacks count as blank."""
    have = lambda f: F.coalesce(F.col(f), F.lit("")) if f in doors.columns else F.lit("")
    first = lambda cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    extra = lambda k: F.element_at("extra", k) if "extra" in doors.columns else F.lit(None).cast("string")
    sides = F.array_join(F.filter(F.array(have("from_space"), have("to_space")), lambda s: s != ""), " to ")
    place = first([sides, *[extra(k) for k in ("location", "lock_function", "room")]])
    outside = F.exists(F.array(have("from_space"), have("to_space"), place), lambda s: s.rlike(r"(?i)\bEXT(ERIOR)?\b"))
    value = {c: have(f) for c, f in DIRECT.items()}
    value |= {c: first([have(OWN_FIELD[c]) for _ in range(c in OWN_FIELD)] + [extra(k) for k in ks]) for c, ks in FROM_EXTRA.items()}
    value |= {"DOOR LOCATION": place, "INTERIOR/EXTERIOR": F.when(outside, "EXTERIOR").otherwise(""), "QUANTITY": F.lit("1"),
              "LEAF COUNT": F.regexp_extract(have("door_width"), r"(?i)^\s*(\d+)\s*[*x]\s*\d", 1)}
    return doors.select(*keep, *[value.get(c, F.lit("")).alias(c) for c in MASTER_COLUMNS])
