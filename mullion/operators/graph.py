"""Greedy choices and components, settled for all groups together in rounds.

Each round decides every row whose answer can no longer change, so the result is
the sequential one while no group is ever gathered in one task. Lineage is cut
with a reliable checkpoint after each round; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mullion.runtime import cut, settled


def first_fit(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Ids kept when nodes are taken best first and one that conflicts with a kept one is dropped.

    ``nodes(id)``; ``conflicts(id, rival)`` lists, per node, the better-placed nodes it clashes with. A node stands for "no
    rival is kept", one literal per rival. A node with a single literal says the same as, or the opposite of, another node, so
    chains of such nodes are followed by pointer doubling, and literals about them become literals about where the chain leads.
    Literals that agree fall together, two that differ settle their node. A chain is so settled in the logarithm of its length,
    and every round also settles all that the plain order settles next. A literal about nothing (null) is a settled node.
    """
    nodes = nodes.select("id").distinct()
    rivals = conflicts.select("id", F.col("rival").alias("anchor")).distinct()
    rivals = rivals.join(nodes.withColumnRenamed("id", "anchor"), "anchor", "left_semi")
    literals = nodes.join(rivals, "id", "left").select("id", "anchor", F.when(F.col("anchor").isNull(), 1).otherwise(0).alias("sign"))

    def follow(df: DataFrame, to: DataFrame) -> DataFrame:
        """Literals about nodes that ``to(id, anchor, sign)`` explains, in terms of what explains them."""
        names = to.select(F.col("id").alias("anchor"), F.col("anchor").alias("_to"), F.col("sign").alias("_sign"))
        j = df.join(names, "anchor", "left")
        told = F.col("_sign").isNotNull()
        return j.select("id", F.when(told, F.col("_to")).otherwise(F.col("anchor")).alias("anchor"),
                        F.when(told, (F.col("sign") == F.col("_sign")).cast("int")).otherwise(F.col("sign")).alias("sign"))

    def merged(df: DataFrame) -> DataFrame:
        per = df.groupBy("id", "anchor").agg(F.min("sign").alias("sign"), F.max("sign").alias("_most"))
        state = per.groupBy("id").agg(F.max(F.when(F.col("anchor").isNull(), F.col("sign") == 0).otherwise(F.col("sign") != F.col("_most"))).alias("_lost"), F.count("anchor").alias("_open"))
        stays = per.filter("anchor IS NOT NULL").join(state.filter("NOT _lost"), "id", "left_semi").select("id", "anchor", "sign")
        done = state.filter("_lost OR _open = 0").select("id", F.lit(None).cast(per.schema["anchor"].dataType).alias("anchor"), F.when(F.col("_lost"), 0).otherwise(1).alias("sign"))
        return stays.unionByName(done)

    while True:
        literals = cut(literals)
        size, still = literals.agg(F.count(F.lit(1)), F.count("anchor")).first()
        literals = literals.coalesce(size // 200_000 + 1)  # rounds over a small frame stay few tasks
        if not still:
            return literals.filter("sign = 1").select("id")
        alone = literals.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("anchor").alias("anchor"), F.first("sign").alias("sign")).filter("_n = 1").drop("_n")
        twice = follow(alone, alone)
        literals = merged(follow(literals, follow(twice, twice)))


def widest_matching(wanted: DataFrame) -> DataFrame:
    """(a, b) pairs, each side once, as many as there can be over the edges ``wanted(a, b, turn, liking)``.

    First every ``a`` asks for the ``b`` it likes best and the one whose turn is first gets it. Then, in phases, layers of a
    breadth-first search grow from all free ``a`` at once: a ``b`` is claimed by one tree, and what holds it is in the next layer.
    In the first layer that reaches free ``b``, each tree that did hands its path over: every ``a`` on it moves on to the next ``b``.
    Trees share nothing, so all paths of a phase are taken together; a search that reaches nothing ends it. A phase serves
    every tree that can be served by a path of its length, so phases are few, and no piece of the graph meets in one task.
    """
    wanted = cut(wanted.select("a", "b", "turn", "liking"))
    best = wanted.groupBy("a").agg(F.min_by(F.struct("b", "turn"), "liking").alias("w"))
    held = settled(best.groupBy(F.col("w.b").alias("b")).agg(F.min_by("a", "w.turn").alias("a")).select("a", "b"))
    turns = settled(wanted.groupBy("a").agg(F.min("turn").alias("turn")))
    while True:
        layer = turns.join(held, "a", "left_anti").select("a", F.col("a").alias("root"), "turn")
        layers: list[DataFrame] = []  # what each layer claimed: (b, a, root, turn, holder)
        while True:
            open_edges = wanted.select("a", "b", "liking").join(layer, "a")
            if layers:
                open_edges = open_edges.join(reduce(DataFrame.unionByName, layers).select("b"), "b", "left_anti")
            claim = open_edges.groupBy("b").agg(F.min_by(F.struct("a", "root"), F.struct("turn", "liking")).alias("c"), F.min("turn").alias("turn"))
            new = cut(claim.join(held.withColumnRenamed("a", "holder"), "b", "left").select("b", "c.a", "c.root", "turn", "holder"))
            size, free = new.agg(F.count(F.lit(1)), F.count(F.when(F.col("holder").isNull(), 1))).first()
            layers.append(new.coalesce(size // 200_000 + 1))
            if free or not size:
                break
            layer = layers[-1].select(F.col("holder").alias("a"), "root", "turn")
        if not free:
            return held
        # Back along each path: the a that claimed the end gets it, and gives up its own b to the a that claimed that one a layer
        # earlier. Each step is written, so no plan holds more than one of them.
        step = cut(layers.pop().filter("holder IS NULL").groupBy("root").agg(F.min_by(F.struct("a", "b"), "b").alias("s")).select("root", "s.a", "s.b"))
        moves = step.select("a", "b")
        for claimed in reversed(layers):
            step = cut(step.select("root", F.col("a").alias("holder")).join(claimed.select("root", "holder", "a", "b"), ["root", "holder"]).select("root", "a", "b"))
            moves = moves.unionByName(step.select("a", "b"))
        moves = settled(moves)
        held = settled(held.join(moves, "a", "left_anti").unionByName(moves))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over ``edges(a, b)``.

    Alternating large-star and small-star steps: neighbours move to the smallest
    one known, so the number of rounds grows with the logarithm of the longest path.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = settled(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = settled(large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(m.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        e, now = small, mark(small)
        if now == was:
            break
        was = now
    members = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def ordered_cover(pairs: DataFrame, group: Sequence[str], need: Column) -> DataFrame:
    """Sheets kept when taken by rank, each only if it adds at least ``need`` tags no kept sheet has.

    ``pairs(*group, sheet, rank, n, tag)`` lists each sheet's tags with its size ``n``.
    A sheet is settled once even the most, or the least, its undecided betters could
    cover gives the same answer.
    """
    group = list(group)
    open_pairs = cut(pairs)
    covered = cut(pairs.limit(0).groupBy(*group, "tag").agg(F.min("rank").alias("k")))
    decided = []
    while not open_pairs.isEmpty():
        first = open_pairs.groupBy(*group, "tag").agg(F.min("rank").alias("u"))
        seen = open_pairs.join(first, [*group, "tag"]).join(covered, [*group, "tag"], "left")
        sure = F.coalesce(F.col("k") < F.col("rank"), F.lit(False))
        score = seen.groupBy(*group, "sheet", "rank", "n").agg(
            F.sum(sure.cast("int")).alias("sure"), F.sum((sure | (F.col("u") < F.col("rank"))).cast("int")).alias("maybe"))
        state = F.when(F.col("n") - F.col("maybe") >= need, True).when(F.col("n") - F.col("sure") < need, False)
        verdict = cut(score.withColumn("kept", state).filter("kept IS NOT NULL").select(*group, "sheet", "rank", "n", "kept"))
        decided.append(verdict)
        taken = open_pairs.join(verdict.filter("kept"), [*group, "sheet"], "left_semi")
        covered = cut(covered.unionByName(taken.select(*group, "tag", F.col("rank").alias("k"))).groupBy(*group, "tag").agg(F.min("k").alias("k")))
        open_pairs = cut(open_pairs.join(verdict, [*group, "sheet"], "left_anti"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def best_gain_cover(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sheets added by largest gain until every tag is covered (ties: lowest rank).

    A sheet whose gain beats every sheet it shares an uncovered tag with is taken at
    once: nothing taken elsewhere can change it.
    """
    group = list(group)
    left = cut(pairs.select(*group, "sheet", "rank", "tag"))
    picks = []
    while not left.isEmpty():
        gain = left.groupBy(*group, "sheet").agg(F.count(F.lit(1)).alias("g"))
        scored = left.join(gain, [*group, "sheet"]).withColumn("s", F.struct("g", -F.col("rank")))
        top = scored.groupBy(*group, "tag").agg(F.max("s").alias("top"))
        wins = cut(scored.join(top, [*group, "tag"]).groupBy(*group, "sheet", "rank")
                   .agg(F.min((F.col("s") == F.col("top")).cast("int")).alias("all"), F.max("g").alias("gain"))
                   .filter("all = 1").select(*group, "sheet", "rank", "gain"))
        picks.append(wins)
        done = left.join(wins, [*group, "sheet"], "left_semi").select(*group, "tag").distinct()
        left = cut(left.join(done, [*group, "tag"], "left_anti"))
    out = picks[0] if picks else pairs.limit(0).select(*group, "sheet", "rank", F.lit(0).cast("bigint").alias("gain"))
    for p in picks[1:]:
        out = out.unionByName(p)
    return out
