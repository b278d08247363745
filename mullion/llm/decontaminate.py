"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

DataFrame functions only. Every benchmark item gives windows of its own length something to meet: a window whose weighted
similarity with the item reaches the threshold t holds at least one of any m - ceil(t m) + 1 of the item's m shingles, so
windows are laid where such an anchor lies in a text, at every start that covers it, each once. A window's 64-bit SimHash
then meets the items through eight 8-bit blocks: two fingerprints at most 23 bits apart differ by at most 2 bits in one of
the eight, and every item is listed under all values that near, so no fingerprint within the radius is missed. What is
within the radius is compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from mullion.llm.common import picked, plain
from mullion.runtime import cut

RADIUS = 23            # = 8 * (2 + 1) - 1; a pair at similarity 0.8 is 10 bits apart in the mean, with a deviation of 3
BLOCKS = 8
BROADCAST_BYTES = 1 << 26  # size of a side of the benchmark up to which it is broadcast; beyond, the join shuffles
ROW_BYTES = 64             # of a row of up to four numbers, with its place in the hash table


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(plain(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(text: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words of a text, in order; none if it has fewer."""

    def runs(marks):
        at = F.sequence(F.lit(0), F.size(marks) - k)
        return F.when(F.size(marks) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(marks, i + j) for j in range(k)])))

    # The outer transform binds the words' hashes to a name, so they are made once and not per run.
    named = F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), runs)
    return F.coalesce(F.get(named, F.lit(0)), F.array().cast("array<bigint>"))


def simhash(window: Column, lanes: int = 16) -> Column:
    """64-bit SimHash of an array of hashes: bit b is set where more than half of them have it.

    Bits are counted 64/``lanes`` at a time, as ``lanes``-bit numbers side by side in one long.
    """
    mask, lane = sum(1 << s for s in range(0, 64, lanes)), (1 << lanes) - 1
    zero = F.lit(0).cast("bigint")

    def add(counts, h):
        return F.transform(counts, lambda c, j: c + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(mask)))

    def majority(counts):
        def bit(b):
            count = F.call_function("shiftrightunsigned", F.get(counts, b % lanes), F.floor(b / lanes).cast("int") * lanes).bitwiseAND(F.lit(lane))
            return F.when(count * 2 > F.size(window), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(zero)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda out, b: out.bitwiseOR(bit(b)))

    return F.aggregate(window, F.array_repeat(zero, lanes), add, majority)


def _near_values() -> list[int]:
    """Differences of at most two bits within a block of eight."""
    return [0, *[1 << i for i in range(8)], *[(1 << i) | (1 << j) for i in range(8) for j in range(i)]]


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of shingles, each weighted by how often it occurs."""
    common = F.array_intersect(a, b)
    often = F.aggregate(common, F.lit(0), lambda acc, g: acc + F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))))
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(once, F.size(common)).otherwise(often)
    return both / (F.size(a) + F.size(b) - both)


def _sized(side: DataFrame, rows: int, extra: int = 0) -> DataFrame:
    """Broadcast hint by a bound: ``rows`` rows of numbers at most, and ``extra`` bytes of arrays and ids in all."""
    return F.broadcast(side) if rows * ROW_BYTES + extra <= BROADCAST_BYTES else side


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Best window per document and item at or above ``percent`` hundredths: doc_id, item_id, start, length (in words), distance, similarity.

    Texts are read whole, in lower case, cut at ASCII white space. Items of fewer than ``k`` words are one shingle of their
    own length; null and empty texts and items match nothing. Documents shorter than an item are one window. Rows that
    repeat an id are searched each and reported under it once; ties go to the first window. Items that repeat an id too.
    """
    items = picked(benchmark, item_id=item_col, text=item_text).withColumn("size", F.size(words(F.col("text")))).filter("size > 0")
    shorts = [r.k for r in items.select(F.least("size", F.lit(k)).alias("k")).distinct().collect()]  # k values at most
    source = picked(docs, doc_id=id_col, text=text_col).withColumn("text", plain(F.col("text")))
    found = None
    for width in sorted(shorts, reverse=True):
        own = items.filter(F.least("size", F.lit(k)) == width)
        part = _search(source, own, width, percent)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return source.limit(0).select("doc_id", F.lit(0).cast("bigint").alias("item_id"), *[F.lit(0).alias(c) for c in ("start", "length", "distance")], F.lit(0.0).alias("similarity"))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("worst"), "start", "length", "distance")).alias("w"))
    return best.select("doc_id", "item_id", "w.start", "w.length", "w.distance", (-F.col("w.worst")).alias("similarity"))


def _search(source: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    own = cut(items.select("item_id", shingles(F.col("text"), width).alias("grams")).withColumn("m", F.size("grams")).distinct().withColumn("entry", F.monotonically_increasing_id()))
    id_bytes = F.octet_length(F.col("item_id").cast("string"))
    longest, total, entries, named = own.agg(F.coalesce(F.max("m"), F.lit(1)), F.coalesce(F.sum("m"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(id_bytes), F.lit(0))).first()
    lanes = 16 if longest < 1 << 15 else 32
    # The anchors of an item: as many of its shingles as a window at the threshold cannot all miss.
    need = F.col("m") - F.ceil(F.col("m") * percent / 100).cast("int") + 1
    anchors = own.select("m", F.explode(F.slice(F.array_sort("grams"), F.lit(1), need)).alias("gram")).distinct()
    texts = source.select("doc_id", F.xxhash64("text").alias("mark"), shingles(F.col("text"), width).alias("grams"))
    # The outer form keeps Spark from making all shingles a second time to filter empty arrays; the join drops them.
    hits = texts.select("doc_id", "mark", "grams", F.posexplode_outer("grams").alias("pos", "gram")).join(_sized(anchors, total), "gram")
    n = F.size("grams")
    first = F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1)
    hits = hits.select("doc_id", "mark", "pos", "m", n.alias("n"), first.alias("base"), F.slice("grams", first + 1, F.col("m") * 2 - 1).alias("around")).distinct()
    # A window belongs to the first anchor it covers: starts after the anchor before this one.
    before = F.lag("pos").over(Window.partitionBy("doc_id", "mark", "m").orderBy("pos"))
    low = F.greatest(F.col("base"), F.coalesce(before + 1, F.lit(0)))
    high = F.least(F.col("pos"), F.greatest(F.col("n") - F.col("m"), F.lit(0)))
    starts = hits.withColumn("low", low).withColumn("high", high).filter("low <= high")
    laid = starts.select("doc_id", "m", "base", "around", F.explode(F.sequence("low", "high")).alias("start"))
    laid = laid.select("doc_id", "m", "start", F.slice("around", F.col("start") - F.col("base") + 1, F.col("m")).alias("window"))
    laid = cut(laid.withColumn("print", simhash(F.col("window"), lanes)))
    blocks = lambda p: F.array(*[F.shiftrightunsigned(p, 8 * b).bitwiseAND(F.lit(255)) + 256 * b for b in range(BLOCKS)])
    keyed = cut(own.withColumn("own_print", simhash(F.col("grams"), lanes)))
    near = F.array(*[F.lit(d) for d in _near_values()])
    listed = keyed.select("m", "entry", "own_print", F.explode(blocks(F.col("own_print"))).alias("block"))
    listed = listed.select("m", "entry", "own_print", F.explode(F.transform(near, lambda d: F.col("block").bitwiseXOR(d))).alias("block"))
    met = laid.withColumn("block", F.explode(blocks(F.col("print")))).join(_sized(listed, entries * BLOCKS * len(_near_values())), ["m", "block"])
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("own_print")))
    # A pair met in several blocks is taken at the first of them.
    apart = F.col("print").bitwiseXOR(F.col("own_print"))
    close = [F.bit_count(F.shiftrightunsigned(apart, 8 * b).bitwiseAND(F.lit(255))) <= 2 for b in range(BLOCKS)]
    earliest = reduce(lambda rest, b: F.when(close[b], F.lit(b)).otherwise(rest), reversed(range(BLOCKS)), F.lit(BLOCKS))
    met = met.withColumn("distance", distance).filter((F.col("distance") <= RADIUS) & (F.floor(F.col("block") / 256) == earliest))
    # Only what is near meets the items' ids and shingles.
    whole = keyed.select("entry", "item_id", F.col("grams").alias("item"))
    met = met.join(_sized(whole, entries, 8 * total + named), "entry")
    met = met.withColumn("similarity", similarity(F.col("window"), F.col("item"))).filter(F.col("similarity") * 100 >= percent)
    return met.select("doc_id", "item_id", "start", (F.size("window") + width - 1).alias("length"), F.col("distance").cast("int"), "similarity")
