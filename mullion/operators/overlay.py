"""Newest-per-key overlays, summaries and lookups over the stored takeoff tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mullion.runtime import small

# The four corrected columns of the current-doors view: view name -> door field.
OVERLAID = {"width": "door_width", "height": "door_height", "type": "door_type", "material": "door_material"}


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Newest row per key by ``order`` (largest wins).

    An aggregate rather than a ranked window: partial aggregation keeps one row
    per key and task, so a key holding a third of the table never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by ``order`` (smallest wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def applied_fixes(corrections: DataFrame) -> DataFrame:
    """(document, tag) -> map of corrected fields and the time of the last one.

    Ranking comes before the null filter: a newest null withdraws the older
    corrections of its field.
    """
    newest = latest(corrections, ["document_id", "door_tag", "field"], ["created_at", "id"])
    return (newest.filter("now_value IS NOT NULL")
            .groupBy("document_id", "door_tag")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "now_value")))).alias("fixes"),
                 F.max("created_at").alias("edited_at")))


def doors_current(doors: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every door with its newest corrections laid over the reading."""
    joined = doors.join(applied_fixes(corrections), ["document_id", "door_tag"], "left")
    return joined.select(
        *doors.columns,
        *[F.coalesce(F.element_at("fixes", field), F.col(field)).alias(name) for name, field in OVERLAID.items()],
        F.col("fixes").isNotNull().alias("edited"), "edited_at",
        F.coalesce("fixes", F.create_map().cast("map<string,string>")).alias("corrected"))


def effective_doors(doors: DataFrame, corrections: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Doors with every corrected field replaced in place, nulls skipped."""
    joined = doors.join(applied_fixes(corrections), ["document_id", "door_tag"], "left")
    return joined.select(*[
        F.coalesce(F.element_at("fixes", c), F.col(c)).alias(c) if c in fields else F.col(c)
        for c in doors.columns])


def run_scorecard(runs: DataFrame, docs: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per run with its document and project, where it has them."""
    return (runs.alias("r")
            .join(docs.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
            .join(small(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))),
                  "project_id", "left")
            .select("id", "project", "filename", "kind", "r.status", "doors_scheduled", "doors_located",
                    located_pct(F.col("doors_located"), F.col("doors_scheduled")).alias("located_pct"), "cost_usd"))


def located_pct(located: Column, scheduled: Column) -> Column:
    """Rounded percentage (half away from zero), null when nothing is scheduled."""
    share = F.lit(100).cast("decimal(20,1)") * located.cast("decimal(20,0)") / scheduled.cast("decimal(20,0)")
    return F.when(F.coalesce(scheduled, F.lit(0)) > 0, F.round(share, 0).cast("bigint"))


def per_document(docs: DataFrame, doors: DataFrame, swings: DataFrame) -> DataFrame:
    """Counts per document: doors, and measured primary detections."""
    n_doors = doors.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("doors"))
    n_swings = swings.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("swings_measured"))
    return (docs.join(n_doors, "id", "left").join(n_swings, "id", "left")
            .select("id", "project_id", "created_at", F.coalesce("doors", F.lit(0)).alias("doors"),
                    F.coalesce("swings_measured", F.lit(0)).alias("swings_measured")))


def rolled(counts: DataFrame) -> DataFrame:
    return counts.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("doors").alias("doors"),
        F.sum("swings_measured").alias("swings_measured"), F.max("created_at").alias("last_upload"))


def corrected_doors(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct corrected tags per project (deduplicated per document before the join)."""
    tags = corrections.select("document_id", "door_tag").distinct()
    return (tags.join(docs.select(F.col("id").alias("document_id"), "project_id"), "document_id")
            .groupBy("project_id").agg(F.countDistinct("door_tag").alias("doors_corrected")))


def spend(runs: DataFrame) -> DataFrame:
    return runs.groupBy("project_id").agg(F.sum("cost_usd").alias("spent_usd"))


def project_summary(projects, docs, doors, swings, corrections, runs, active_only: bool = False) -> DataFrame:
    """Summary per project. Each child is aggregated before it meets the parent,
    so no join multiplies another child's rows."""
    base = projects.filter("status = 'active'") if active_only else projects
    parts = [rolled(per_document(docs, doors, swings)), corrected_doors(corrections, docs), spend(runs)]
    joined = reduce(lambda a, b: a.join(b.withColumnRenamed("project_id", "id"), "id", "left"), parts, base)
    zero = F.lit(0)
    return joined.select(
        "id", "name", "code", "status",
        *[F.coalesce(c, zero).alias(c) for c in ("documents", "doors", "swings_measured", "doors_corrected")],
        F.coalesce("spent_usd", F.lit(0).cast("decimal(10,4)")).alias("spent_usd"), "last_upload")


def first_per_door(doors: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """First row per (document, tag, level), blanks all kept; and the repeats dropped."""
    tagged, blank = doors.filter("door_tag <> ''"), doors.filter("coalesce(door_tag, '') = ''")
    keys = ["document_id", "door_tag", "level"]
    kept = earliest(tagged, keys, order).select(*doors.columns)
    repeats = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    return kept.unionByName(blank), repeats


def elect_primary(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary sighting per tag and, on every row, the sheets the tag is drawn on (by scale, then page).

    Only those short sheet lists are gathered per tag; the rows themselves are not.
    """
    rank = F.struct(F.col("has_arc").cast("int"), F.col("scale"), -F.col("page"), -F.col("id"))
    summary = det.groupBy(*keys).agg(
        F.max_by("id", rank).alias("primary_id"), F.max_by("page", rank).alias("counted_on"),
        F.array_sort(F.collect_list(F.struct("scale", "page"))).alias("_on"))
    return (det.join(summary, list(keys))
            .withColumn("is_primary", F.col("id") == F.col("primary_id"))
            .withColumn("also_on", F.col("_on.page")).drop("_on", "primary_id"))


def fields_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled): whether any row has a value, in one pass over the data."""
    one = df.agg(*[F.coalesce(F.max(F.coalesce(F.col(c), F.lit("")) != ""), F.lit(False)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "filled")
