"""JSON replies of remote models, as they were stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def read_objects(df: DataFrame, col: str, fields: str) -> DataFrame:
    """Array of flat objects in a reply; whole objects are salvaged from one that was cut off."""
    whole = F.from_json(col, f"array<struct<{fields.replace(' ', ':')}>>", {"mode": "PERMISSIVE"})
    closed = F.trim(F.col(col)).rlike(r"(?s)^\[.*\]$")
    salvaged = F.transform(F.regexp_extract_all(F.col(col), F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.from_json(o, fields))
    return df.withColumn("truncated", ~closed).withColumn("objects", F.when(closed, whole).otherwise(salvaged))


def accept_rows(df: DataFrame, col: str, fields: str, valid) -> DataFrame:
    """Rows parsed one by one with a flag; a bad row never takes the rest with it."""
    parsed = df.withColumn("_p", F.from_json(col, f"{fields}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.withColumn("accepted", F.coalesce(F.col("_p._corrupt").isNull() & valid(F.col("_p")), F.lit(False)))
