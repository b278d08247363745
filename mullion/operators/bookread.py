"""Price-book pages read into price rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mullion.operators import sequence as seq
from mullion.runtime import cut


def finish_blocks(lines: DataFrame, keys: Sequence[str], order: str, width: float) -> DataFrame:
    """Numbers blocks of price lines: a new one where ``forced``, or at a finish the block already has.

    Forced breaks cut the fold into segments; within one, a block starts at the
    first line whose finish last stood inside the open block.
    """
    keys = list(keys)
    bucket = F.floor(F.col(order) / width)
    seg = seq.running(lines.withColumn("_f", F.col("forced").cast("int")), keys, bucket, [order], {"_seg": ("sum", F.col("_f"))})
    twin = seq.running(seg, [*keys, "_seg", "finish"], bucket, [order], {"_twin": ("last", F.col(order))}, inclusive=False)
    # Only repeats can start a block, so only they enter the fold.
    repeats = twin.filter("_twin IS NOT NULL").groupBy(*keys, "_seg").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_twin").alias("t")))).alias("_r"))
    starts = repeats.select(*keys, "_seg", F.aggregate(
        "_r", F.array().cast("array<bigint>"),
        lambda a, r: F.when((F.size(a) == 0) | (r.t >= F.element_at(a, -1)), F.concat(a, F.array(r.o.cast("bigint")))).otherwise(a)).alias("_s"))
    opened = twin.join(starts.select(*keys, F.explode("_s").alias(order), F.lit(1).alias("_start")), [*keys, order], "left")
    first = seq.running(opened, keys, bucket, [order], {"_n": ("sum", F.lit(1))}, inclusive=False)
    new = F.when((F.col("_n") == 0) | F.col("forced") | F.col("_start").isNotNull(), 1).otherwise(0)
    return seq.running(first.withColumn("_new", new), keys, bucket, [order], {"block": ("sum", F.col("_new"))}).drop(
        "_f", "_seg", "_twin", "_start", "_n", "_new")


def read_finish_columns(pieces: DataFrame, keys: Sequence[str], reach: float = 15.0, stack: float = 10.0) -> DataFrame:
    """Price rows of tables headed 'PRICE BASED ON FINISH'.

    ``pieces(keys, yc, x0, x1, text)``. Finish words between the anchor and the first price line make
    the columns; every price goes to the nearest column within ``reach``; the model is spelled from
    'product . function', with '-F' on fire rated rows.
    """
    from mullion.functions import text, vocab

    keys = list(keys)
    # The lines and their facts feed several joins: written once, not worked out again for each.
    lines = cut(seq.mean_lines(pieces, keys, "yc", 2.5, 64.0).withColumnRenamed("line_start", "line"))
    money = F.col("text").rlike(vocab.MONEY_RE)
    facts = lines.groupBy(*keys, "line").agg(F.max(F.contains("text", F.lit("PRICE BASED ON FINISH"))).alias("anchor"), (F.max(money) & F.max(F.col("text") == ".")).alias("row"))
    bucket = F.floor(F.col("line") / 256)
    facts = seq.running(facts, keys, bucket, ["line"], {"block": ("last", F.when(F.col("anchor"), F.col("line")))})
    facts = seq.running(facts, [*keys, "block"], bucket, ["line"], {"_rows": ("sum", F.col("row").cast("int"))}, inclusive=False).filter("block IS NOT NULL AND NOT anchor")
    j = cut(lines.join(facts.select(*keys, "line", "block", "row", "_rows"), [*keys, "line"]).withColumn("xc", (F.col("x0") + F.col("x1")) / 2))
    heads = j.filter("NOT row AND _rows = 0").withColumn("fin", F.explode(text.finishes_in(F.col("text"))))
    cols = seq.anchored(heads, [*keys, "block"], "xc", stack, 512.0).select(*keys, "block", F.col("cluster").alias("cx"), "fin").distinct()
    rows = j.filter("row")
    first = rows.filter(money).groupBy(*keys, "line").agg(F.min("x0").alias("_first"))
    left = (rows.join(first, [*keys, "line"]).filter("x0 > 30 AND x0 < _first").groupBy(*keys, "line")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s.text).alias("l")))
    at = lambda i: F.get("l", F.lit(i))
    left = left.filter((F.size("l") >= 3) & (at(1) == ".") & (at(2) != ".") & ~F.startswith(at(2), F.lit("[")))
    model = left.select(*keys, "line", F.explode(text.expand_product(at(0))).alias("_p"), at(2).alias("_f"), F.array_contains(F.slice("l", F.lit(4), F.size("l")), "F").alias("_fire"))
    model = model.select(*keys, "line", F.concat("_p", "_f", F.when(F.col("_fire"), "-F").otherwise("")).alias("model"))
    price = rows.filter(money).select(*keys, "block", "line", "xc", F.col("text").alias("price_text"))
    near = price.join(cols.select(*keys, "block", "cx").distinct(), [*keys, "block"]).withColumn("_d", F.abs(F.col("cx") - F.col("xc"))).filter(F.col("_d") <= reach)
    near = near.groupBy(*keys, "block", "line", "xc", "price_text").agg(F.min_by("cx", F.struct("_d", "cx")).alias("cx"))
    return (near.join(cols, [*keys, "block", "cx"]).join(model, [*keys, "line"])
            .select(*keys, "line", "xc", "model", F.lit("base").alias("kind"), F.col("fin").alias("finish"), "price_text", text.amount(F.col("price_text")).alias("list_price")))
