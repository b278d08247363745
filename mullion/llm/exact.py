"""Exact duplicates by most-significant-digit radix partitioning of the text itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mullion.llm.common import SPACE, plain
from mullion.runtime import cut


def squeezed(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(plain(text), SPACE, " ")


def exact_groups(docs: DataFrame, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text",
                 first: int = 64, growth: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and ``carry``'s columns as ``carried_<name>``.

    All documents start in one group. A round splits every open group by the next bytes of its texts: a text is known
    by its group and those bytes alone, compared as bytes, never by a digest. A group of one document, and one whose
    texts have ended (they are then equal), is settled; the rest goes into the next round with a digit ``growth`` times
    as wide, so the rounds grow with the logarithm of the longest shared prefix. Group sizes and smallest ids are
    aggregates that combine before the shuffle, so a group of a third of all rows is a few rows there, and joining them
    back lets Spark split a large group. Only the rows still open keep their text, in a reliable checkpoint.

    ``kept`` is true for one row of each group of equal texts, that with the smallest doc_id; among rows that repeat
    that id as well, one. Null and empty texts are equal; null ids come last. ``text_sha256`` only describes the text.
    """
    carry, with_text = list(carry), text_col in carry
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry) if c != text_col]
    one = F.struct(*others) if others else F.lit(0)
    name = F.col(f"`{id_col}`")
    state = docs.select(
        name.alias("id"), F.col(f"`{text_col}`").alias("text"), one.alias("more"), F.monotonically_increasing_id().alias("row"))
    # A label any row of a group would compute alike; it names the group, it does not decide equality.
    label = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.xxhash64(squeezed(F.col("text"))).alias("mark"))
    state = state.withColumn("label", label).withColumn("sha", F.sha2(squeezed(F.col("text")).cast("binary"), 256)).withColumn("group", label)
    state = state.withColumn("group", F.lit(None).cast(state.schema["label"].dataType))
    done, at, width, keys = [], 1, first, ["group", "ended", "digit"]
    while True:
        bytes_ = squeezed(F.col("text")).cast("binary")
        cutting = state.withColumn("digit", F.substring(bytes_, at, width)).withColumn("ended", F.octet_length(bytes_) < at + width)
        groups = cutting.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lowest")).filter("size > 1")
        g = groups.select(*[F.col(k).alias(f"g_{k}") for k in keys], "size", "lowest")
        met = cutting.join(g, F.col("group").eqNullSafe(F.col("g_group")) & (F.col("ended") == F.col("g_ended")) & (F.col("digit") == F.col("g_digit")), "left")
        open_ = F.col("size").isNotNull() & ~F.col("ended")
        step = cut(met.select("id", "row", "label", "sha", "more", "lowest", "size", open_.alias("open"),
                              (F.col("text") if with_text else F.when(open_, F.col("text"))).alias("text")))
        done.append(step.filter("NOT open"))
        state = step.filter("open").withColumn("group", F.col("lowest")).drop("open", "size", "lowest")
        if state.isEmpty():
            break
        at, width = at + width, width * growth
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    # Where the smallest id itself comes twice with one text, its first row stays.
    best = (settled.filter(F.col("size").isNotNull() & (F.col("label") == F.col("lowest")))
            .groupBy(F.col("lowest").alias("w_lowest")).agg(F.min("row").alias("winner")))
    out = settled.join(best, F.col("lowest") == F.col("w_lowest"), "left")
    more = [(F.col("text") if c == text_col else F.col(f"more.c{i}")).alias(f"carried_{c}") for i, c in enumerate(carry)]
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("lowest.id"))
    return out.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("size").isNull() | F.coalesce(F.col("row") == F.col("winner"), F.lit(False))).alias("kept"), F.col("sha").alias("text_sha256"),
        *more)
