"""Merkle manifest of a table: a tree of digests per group, a tree over the groups, and a proof for every row.

Nodes of a level stand in rows with their position in the group. Windows over aligned stretches of positions look a fixed
number of rows back and ahead; what lies outside a node's run of ``FAN`` is masked by its slot and the length of the run,
which leaves the siblings. The first child of a run hashes its parent. Nothing is gathered by group: a position comes from
the sorted ranges of the table, a window never holds more than ``STRETCH`` rows, and a parent meets its own children only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mullion.llm.common import picked
from mullion.runtime import cut

FAN = 16         # children of a node
STRETCH = 256    # rows of a window; a multiple of FAN
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours can't run together; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``pos`` of each row in its ``key`` by ``order``, from 0, and the group's size ``n``; equal rows in any order.

    The table is dealt into sorted ranges once, and held fast by a checkpoint; a row's place is its place in its range
    plus what earlier ranges hold of the key, so a group of any size spreads over many tasks.
    """
    columns = nodes.columns
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("key", *order, "tie").sortWithinPartitions("key", *order, "tie")
    ranged = cut(ranged.select(*columns, F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at")))
    sizes = ranged.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    group = Window.partitionBy("key")
    before = F.coalesce(F.sum("rows").over(group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("key", "piece", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return ranged.join(starts, ["key", "piece"]).select(*columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``left`` and ``right``: the digests before and after a node in its run, one after the other."""
    w = Window.partitionBy("key", F.floor(F.col("pos") / STRETCH)).orderBy("pos")
    slot = F.col("pos") % FAN
    run = F.least(F.lit(FAN).cast("bigint"), F.col("n") - F.col("pos") + slot)
    back = [F.when(slot >= k, F.lag("digest", k).over(w)) for k in range(FAN - 1, 0, -1)]
    ahead = [F.when(slot + k < run, F.lead("digest", k).over(w)) for k in range(1, FAN)]
    joined = lambda many: F.concat_ws("", *many)  # noqa: E731  masked columns are null and leave nothing
    return nodes.select("*", joined(back).alias("left"), joined(ahead).alias("right"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """(key, pos, n, digest) of every level, leaves first; a group whose level has one node is not in the next."""
    out = [leaves.select("key", "pos", "n", "digest")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = with_siblings(out[-1].filter("n > 1")).filter(F.col("pos") % FAN == 0)
        up = first.select("key", F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))
        out.append(cut(up))
        most = -(-most // FAN)
    return out


def proven(leaves: DataFrame, tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with the path of each to the top: (left, right) of every level, then that of its group in ``above``.

    ``above(key, path, top, ...)`` tells how a group's own root goes on. Paths are handed from a node to its children.
    """
    rest = [c for c in above.columns if c not in ("key", "path")]
    known = None
    for level in reversed([leaves, *tree[1:]]):
        roots = level.filter("n = 1").join(above, "key").select(*level.columns, "path", *rest)
        if known is None:
            known = roots
            continue
        step = F.array(F.struct(F.col("left"), F.col("right")))
        up = known.select("key", F.col("pos").alias("parent"), F.col("path").alias("onward"), *rest)
        inner = with_siblings(level.filter("n > 1")).withColumn("parent", F.floor(F.col("pos") / FAN)).join(up, ["key", "parent"])
        known = inner.select(*level.columns, F.concat(step, "onward").alias("path"), *rest).unionByName(roots)
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the five FIELDS. Groups are the values of source, null being one, in the order of their bytes
    with null first; leaves ascend by doc_id, null first, and rows that share an id by their leaf. Rows alike in all fields
    are leaves each. Where 5 divides the crc32 of the id, the row is tampered with: its text's A-Z are in lower case when
    the root is folded from its proof. Null texts and ids are not tampered with. A table of one row is its own root, its
    proof the digest of nothing; an empty one gives none. Other columns don't count.
    """
    rows = picked(docs, **{c: c for c in FIELDS})
    whole = digest(*[field(F.col(c)) for c in FIELDS])
    lowered = digest(*[field(F.col(c)) for c in FIELDS[:-1]], field(F.translate(F.col("text"), UPPER, LOWER)))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # sorts null before every value
    rows = rows.select("doc_id", key.alias("key"), whole.alias("digest"), F.when(hit, lowered).alias("changed"))
    leaves = numbered(rows, ["doc_id", "digest"])
    tree = levels(leaves)
    subroots = tree[0].limit(0)
    for level in tree:
        subroots = subroots.unionByName(level.filter("n = 1"))
    forest = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"])
    upper = levels(forest)
    end = upper[-1].select("key", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = cut(proven(forest, upper, end).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "root", "path"))
    found = proven(leaves, tree, above)
    siblings = F.concat_ws("", F.transform("path", lambda p: F.concat(p["left"], p["right"])))
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda acc, p: digest(p["left"], acc, p["right"]))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
