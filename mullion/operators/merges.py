"""Writes as frames: the old table and the incoming rows give the next table.

Nothing is edited in place; a job writes the returned frame over the partitions it covers.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from mullion.operators import detections as det, sequence as seq
from mullion.operators.overlay import earliest, latest
from mullion.operators.spatial import as_other, boxes_overlapping
from mullion.runtime import small


def replace_document(old: DataFrame, new: DataFrame) -> DataFrame:
    """New reading in place of the old one; doors found on the plans stay while the schedule lacks their tag."""
    read = new.select("document_id").distinct()
    scheduled = new.filter("coalesce(door_tag, '') <> ''").select("document_id", "door_tag").distinct()
    untouched = old.join(read, "document_id", "left_anti")
    kept = old.join(read, "document_id", "left_semi").filter("source = 'plan'").join(scheduled, ["document_id", "door_tag"], "left_anti")
    numbered = seq.running(kept, ["document_id"], F.floor(F.col("row_index") / 10_000_000_000), ["row_index", "door_tag"], {"_k": ("sum", F.lit(1))})
    size = new.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = numbered.join(size, "document_id").withColumn("row_index", F.col("_n") + F.col("_k") - 1).select(*old.columns)
    return untouched.unionByName(new).unionByName(kept)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Column | None = None) -> DataFrame:
    """New rows over old ones by key; an old row for which ``keep`` holds stays as it is."""
    keys = list(keys)
    o = old.withColumn("_keep", keep if keep is not None else F.lit(False))
    held = o.filter("_keep").drop("_keep")
    incoming = new.join(held.select(*keys), keys, "left_anti")
    return held.unionByName(incoming).unionByName(o.filter("NOT _keep").drop("_keep").join(new.select(*keys), keys, "left_anti"))


def save_audit(found: DataFrame, sheets: DataFrame, dead: DataFrame, typed: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Detections to store: not suppressed, on a listed sheet, first per (tag, sheet), types set by hand carried over."""
    left = det.suppress(found, dead, keys, reach).join(sheets.select(*keys).distinct(), list(keys), "left_semi")
    one = earliest(left, [*keys, "tag"], ["id"]).select(*found.columns)
    return det.keep_types(one, typed, keys, keys[-1], reach)


def covered(current: DataFrame, pages: DataFrame, tags: DataFrame, regions: DataFrame, cell: float) -> DataFrame:
    """Detections a partial run replaces: on an asked sheet, with an asked tag, inside an asked region."""
    d = current.join(small(pages), "page", "left_semi").join(tags, "tag", "left_semi")
    return det.in_region(d, regions, ["page"], cell)


def save_reprocess(current: DataFrame, found: DataFrame, pages: DataFrame, tags: DataFrame, regions: DataFrame, dead: DataFrame,
                   hand: DataFrame, cell: float, reach: float) -> DataFrame:
    """Next detections after a partial run, each with ``what``: kept, demoted or added.

    Only covered rows are replaced, doors placed by hand win over found ones, and an
    old primary gives way to a new one of the same tag.
    """
    gone = covered(current, pages, tags, regions, cell)
    fresh = det.suppress(found, dead, ["page"], reach).join(hand.select("page", "tag").filter("tag <> ''").distinct(), ["page", "tag"], "left_anti")
    fresh = earliest(fresh, ["page", "tag"], ["id"]).select(*found.columns)
    stay = current.join(gone.select("id"), "id", "left_anti")
    primary = fresh.filter("is_primary AND tag <> ''").select("tag").distinct().withColumn("_new", F.lit(True))
    stay = stay.join(primary, "tag", "left").withColumn("what", F.when(F.col("is_primary") & F.col("_new"), "demoted").otherwise("kept"))
    stay = stay.withColumn("is_primary", F.col("is_primary") & (F.col("what") == "kept"))
    return stay.select(*current.columns, "what").unionByName(fresh.select(*current.columns, F.lit("added").alias("what")))


def record_unread(listed: DataFrame, cleared: DataFrame, fresh: DataFrame, cell: float) -> DataFrame:
    """Unread regions: those overlapping a cleared area go, the newly unread are added."""
    hit = boxes_overlapping(listed, as_other(cleared, ["page"]), ["page"], cell).select("id").distinct()
    return listed.join(hit, "id", "left_anti").unionByName(fresh)


def record_walls(doors: DataFrame, walls: DataFrame) -> DataFrame:
    """Wall types of the primary sightings written onto the doors."""
    w = walls.groupBy("document_id", "door_tag").agg(F.max_by("wall_type", "id").alias("_w"))
    return doors.join(w, ["document_id", "door_tag"], "left").withColumn("wall_type", F.coalesce("_w", "wall_type")).drop("_w")


def correct_many(doors: DataFrame, asked: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Corrections for the asked tags, with the value read; and the tags the document does not have."""
    a = asked.dropDuplicates(["document_id", "door_tag"])
    was = doors.groupBy("document_id", "door_tag").agg(F.min_by(field, "row_index").alias("was"))
    return a.join(was, ["document_id", "door_tag"]).withColumn("field", F.lit(field)), a.join(was, ["document_id", "door_tag"], "left_anti")


def ensure_doors(doors: DataFrame, placed: DataFrame) -> DataFrame:
    """Plan doors for placed tags the document has no door for, numbered after its last row."""
    new = placed.select("document_id", "door_tag").distinct().join(doors.select("document_id", "door_tag").distinct(), ["document_id", "door_tag"], "left_anti")
    last = doors.groupBy("document_id").agg(F.max("row_index").alias("_last"))
    numbered = seq.running(new, ["document_id"], F.substring("door_tag", 1, 2), ["door_tag"], {"_k": ("sum", F.lit(1))})
    return numbered.join(last, "document_id", "left").select("document_id", "door_tag", F.lit("plan").alias("source"), (F.coalesce("_last", F.lit(-1)) + F.col("_k")).alias("row_index"))


def drop_orphans(doors: DataFrame, boxes: DataFrame) -> DataFrame:
    """Plan doors go once no box carries their tag; scheduled doors stay."""
    orphan = doors.filter("source = 'plan'").select("document_id", "door_tag").distinct().join(boxes.select("document_id", "door_tag").distinct(), ["document_id", "door_tag"], "left_anti")
    return doors.filter("source <> 'plan'").unionByName(doors.filter("source = 'plan'").join(orphan, ["document_id", "door_tag"], "left_anti"))


def set_project_status(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """A project's new status copied to its documents."""
    p = projects.select(F.col("id").alias("project_id"), F.col("status").alias("_s"))
    return docs.join(p, "project_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def move_boxes(boxes: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes that stay, tombstones, hand-placed rows) after patches of position or type.

    A patch within 1e-4 on every edge and without a type is a no-op; a type alone is
    edited in place; a move leaves a tombstone and places the box, its arc shifted along.
    """
    p = patches.select("id", *[F.col(c).alias(f"p{c}") for c in ("x0", "y0", "x1", "y1", "kind")])
    j = boxes.join(p, "id", "left")
    shift = F.greatest(*[F.abs(F.coalesce(f"p{c}", c) - F.col(c)) for c in ("x0", "y0", "x1", "y1")])
    moved = F.coalesce(shift > 1e-4, F.lit(False))
    j = j.withColumn("_moved", moved)
    stay = j.filter("NOT _moved").withColumn("kind", F.coalesce("pkind", "kind")).select(*boxes.columns)
    gone = j.filter("_moved")
    tomb = gone.select("id", "page", "tag", "x0", "y0", "x1", "y1")
    dx, dy = (F.coalesce("px0", "x0") - F.col("x0")), (F.coalesce("py0", "y0") - F.col("y0"))
    placed = gone.select("id", "page", "tag", *[F.coalesce(f"p{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce("pkind", "kind").alias("kind"),
                         (F.col("hinge_x") + dx).alias("hinge_x"), (F.col("hinge_y") + dy).alias("hinge_y"))
    return stay, tomb, placed


def delete_documents(gone: DataFrame, tables: dict[str, DataFrame], key: str = "document_id") -> dict[str, DataFrame]:
    """Every child table without the rows of the deleted documents."""
    ids = gone.select(F.col("id").alias(key)).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def fold_missing(df: DataFrame, known: Sequence[str], extra: str = "extra") -> DataFrame:
    """Columns an older table lacks folded into ``extra``; keys it already has stay."""
    newer = [c for c in df.columns if c not in known and c != extra]
    entries = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in newer]),
                                          lambda e: F.coalesce(e.value, F.lit("")) != ""))
    have = F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(entries, lambda k, v: ~F.map_contains_key(have, k))
    return df.select(*[c for c in df.columns if c in known], F.map_concat(have, fresh).alias(extra))


def confirm(prices: DataFrame, patches: DataFrame) -> DataFrame:
    """Prices set as verified; parts come from the first answer whose total is within 0.005."""
    j = prices.join(patches.select("id", F.col("list_price").alias("_p")), "id", "left")
    hit = F.filter("answers", lambda a: F.abs(a.total - F.col("_p")) < 0.005)
    return j.withColumn("parts", F.when(F.col("_p").isNotNull() & (F.size(hit) > 0), F.get(hit, F.lit(0)).parts).otherwise(F.col("parts"))).withColumn(
        "verified", F.col("verified") | F.col("_p").isNotNull()).withColumn("list_price", F.coalesce("_p", "list_price")).drop("_p")


def log_run(audit: DataFrame) -> DataFrame:
    """Run-log row per document from an audit's detections."""
    return audit.groupBy("document_id").agg(
        F.countDistinct(F.when(F.col("tag") != "", F.col("tag"))).alias("doors_located"), F.count(F.when(F.col("is_primary") & F.col("has_arc"), 1)).alias("swings_measured"),
        F.count(F.lit(1)).alias("detections"))


class Removal(NamedTuple):
    """What is left once tables are removed, and what is remembered of it."""

    doors: DataFrame
    boxes: DataFrame
    schedules: DataFrame
    removed: DataFrame  # (document_id, page, title) for the removal log: ``tables.leave_out_removed`` keeps these out of later readings
    hand_placed: DataFrame  # (document_id, door_tag) of boxes that stay although their door is gone
    refused: DataFrame  # (document_id, schedule_id) whose doors cannot be told apart; nothing of them is touched


def remove_schedules(schedules: DataFrame, doors: DataFrame, boxes: DataFrame, gone: DataFrame) -> Removal:
    """Takes tables away: their doors go, boxes of tags no longer scheduled go, hand-placed boxes stay and are named.

    ``schedules(document_id, schedule_id, page, title, row_count)``, ``doors(document_id, schedule_id, door_tag, row_index,
    source)``, ``boxes(document_id, door_tag, by_hand)``, ``gone(document_id, schedule_id)``. A door's table is the one it
    names; where a document has several tables and all its doors name one, it is found by running row ranges, and the
    document is refused if those do not add up. Entries of ``gone`` that name no table are ignored.
    """
    from mullion.operators import tables as tb

    keys = ["document_id", "schedule_id"]
    gone = gone.select(*keys).distinct().join(schedules.select(*keys).distinct(), keys, "left_semi")
    named = F.when(F.col("source") == "schedule", F.coalesce("schedule_id", F.lit("")))
    shape = (schedules.groupBy("document_id").agg((F.count(F.lit(1)) > 1).alias("_many"))
             .join(doors.groupBy("document_id").agg(F.coalesce(F.min(named) == F.max(named), F.lit(True)).alias("_one")), "document_id", "left"))
    collapsed = shape.filter("_many AND coalesce(_one, true)").select("document_id")
    lined_up = schedules.join(collapsed, "document_id", "left_semi").select("document_id", "page", F.col("schedule_id").alias("table"), "row_count")
    read = doors.filter("source = 'schedule'").join(collapsed, "document_id", "left_semi").select("document_id", "row_index")
    refused = gone.join(collapsed, "document_id", "left_semi").join(tb.order_holds(lined_up, read), "document_id", "left_anti")
    going = gone.join(refused, keys, "left_anti")

    # One pass over the doors: each gets the table it counts to, by name or by order, and whether that one goes.
    by_order = tb.doors_by_order(lined_up, read.distinct()).withColumnRenamed("table", "_ordered").withColumn("_s", F.lit("schedule"))
    marked = doors.join(collapsed.withColumn("_c", F.lit(True)), "document_id", "left").withColumn("_s", F.col("source"))
    marked = marked.join(by_order, ["document_id", "row_index", "_s"], "left").withColumn("_own", F.when(F.col("source") == "schedule", F.when(F.col("_c"), F.col("_ordered")).otherwise(F.col("schedule_id"))))
    marked = marked.join(going.select("document_id", F.col("schedule_id").alias("_own"), F.lit(True).alias("_goes")), ["document_id", "_own"], "left")
    lost = (marked.filter("coalesce(door_tag, '') <> ''").groupBy("document_id", "door_tag").agg(F.min(F.coalesce("_goes", F.lit(False))).alias("_lost")).filter("_lost"))
    flagged = boxes.join(lost, ["document_id", "door_tag"], "left")
    return Removal(
        doors=marked.filter("_goes IS NULL").select(*doors.columns),
        boxes=flagged.filter("_lost IS NULL OR by_hand").select(*boxes.columns),
        schedules=schedules.join(going, keys, "left_anti"),
        removed=schedules.join(going, keys, "left_semi").select("document_id", "page", F.coalesce("title", F.lit("")).alias("title")),
        hand_placed=flagged.filter("_lost AND by_hand").select("document_id", "door_tag").distinct(),
        refused=refused)


def ensure(old: DataFrame, wanted: DataFrame, keys: Sequence[str], new_id: Column) -> DataFrame:
    """Get-or-create by natural key: the old rows and one new row per key not there yet."""
    fresh = wanted.select(*keys).distinct().join(old.select(*keys), list(keys), "left_anti").withColumn("id", new_id)
    return old.unionByName(fresh, allowMissingColumns=True)


def put_codes(codes: DataFrame, books: DataFrame) -> DataFrame:
    """Codes with ``accepted``: the maker needs a book unless marked to have none, and may not be so marked when it has one."""
    b = books.select("manufacturer").distinct().withColumn("_book", F.lit(True))
    return codes.join(small(b), "manufacturer", "left").withColumn("accepted", F.col("_book").isNotNull() != F.col("no_book")).drop("_book")


def record_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Page list upserted on (document, page)."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    return latest(both, ["document_id", "page"], ["_load", "number"]).drop("_load")


def clear_suppressions(tombstones: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tombstones left, and how many each named document lost."""
    lost = tombstones.join(docs.select("document_id").distinct(), "document_id", "left_semi")
    return tombstones.join(docs.select("document_id").distinct(), "document_id", "left_anti"), lost.groupBy("document_id").agg(F.count(F.lit(1)).alias("cleared"))
