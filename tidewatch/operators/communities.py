"""Communities of a weighted graph by modularity: local moves in parallel, then contraction, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import forget, small, written

#: Rounds without a gain, each of which lets half as many nodes move as the one before, after which only moves that do not
#: touch each other are made.
IDLE = 4


def _simple(edges: DataFrame) -> DataFrame:
    """Undirected edges once, weights of repeated ones summed; nulls and weights of 0 or less go."""
    kept = edges.filter("a is not null and b is not null and weight > 0")
    return kept.selectExpr("least(a, b) a", "greatest(a, b) b", "weight").groupBy("a", "b").agg(F.sum("weight").cast("double").alias("weight"))


def _strengths(e: DataFrame) -> DataFrame:
    """node and the weight of its edge ends: a loop has two."""
    return e.selectExpr("a node", "weight").unionByName(e.selectExpr("b node", "weight")).groupBy("node").agg(F.sum("weight").alias("k"))


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: the modularity of ``label`` (node, community) on ``edges`` (a, b, weight), null without edges. Nodes without
    an edge count nothing; an edge with an unlabelled node is in no community."""
    e = _simple(edges)
    ends = _strengths(e).join(label, "node", "left").groupBy("community").agg(F.sum("k").alias("s"))
    of = lambda end: label.select(F.col("node").alias(end), F.col("community").alias(f"c{end}"))
    inner = e.join(of("a"), "a").join(of("b"), "b").filter("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inner"))
    total = ends.agg(F.sum("s").alias("ends"), F.sum(F.when(F.col("community").isNotNull(), F.col("s") * F.col("s"))).alias("squares"))
    share = 2 * F.col("inner") / F.col("ends") - F.coalesce("squares", F.lit(0.0)) / (F.col("ends") * F.col("ends"))
    return total.crossJoin(F.broadcast(inner)).select(share.alias("modularity"))  # one row each


def _votes(both: DataFrame, label: DataFrame, sent: Callable) -> DataFrame:
    """node and the weight of its edges into each community around it and, also if 0, its own."""
    near = both.join(sent(label.select(F.col("node").alias("b"), "c")), "b").select(F.col("a").alias("node"), "c", "weight")
    return written(near.unionByName(label.select("node", "c", F.lit(0.0).alias("weight"))).groupBy("node", "c").agg(F.sum("weight").alias("w")), "moves-votes")


def _quality(votes: DataFrame, label: DataFrame, ends: float, sent: Callable) -> float:
    """Modularity of a level's labels but for its loops, which no move changes."""
    inner = votes.join(sent(label), ["node", "c"]).agg(F.sum("w")).first()[0]
    squares = label.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return inner / ends - squares / (ends * ends)


def _better(votes: DataFrame, label: DataFrame, ends: float, sent: Callable) -> DataFrame:
    """node, its community, the one it gains most by and that gain, for nodes that gain (ties: the smaller id). Of two single nodes only that
    with the larger id joins the other, so they do not change places."""
    sums = label.groupBy("c").agg(F.sum("k").alias("s"), F.count(F.lit(1)).alias("members"))
    mine = label.join(sent(sums.selectExpr("c", "members mates")), "c").selectExpr("node", "c own", "k", "mates")
    rows = votes.join(sent(mine), "node").join(sent(sums), "c")
    at_home = F.col("c") == F.col("own")
    value = F.round(F.col("w") - F.col("k") * (F.col("s") - F.when(at_home, F.col("k")).otherwise(0.0)) / ends, 9)
    open_to = ~at_home & ~((F.col("mates") == 1) & (F.col("members") == 1) & (F.col("c") > F.col("own")))
    best = rows.groupBy("node", "own").agg(F.max(F.when(at_home, value)).alias("stay"), F.min(F.when(open_to, F.struct((-value).alias("v"), "c"))).alias("x"))
    return written(best.filter(-F.col("x.v") > F.col("stay") + 1e-8).select("node", "own", F.col("x.c").alias("to"), (-F.col("x.v") - F.col("stay")).alias("gain")), "moves-better")


def _apart(better: DataFrame, sent: Callable) -> DataFrame:
    """The moves that are the best (ties: the smaller node) of all that leave or enter one of their two communities. No two
    of them touch the same community, so their gains add up, and the best of all is among them."""
    move = F.struct((-F.col("gain")).alias("g"), "node").alias("m")
    first = better.select(F.col("own").alias("c"), move).unionByName(better.select(F.col("to").alias("c"), move)).groupBy("c").agg(F.min("m").alias("m"))
    first = first.select("c", F.col("m.node").alias("node"))
    return better.join(sent(first.withColumnRenamed("c", "own")), ["own", "node"], "left_semi").join(sent(first.withColumnRenamed("c", "to")), ["to", "node"], "left_semi")


def _level(e: DataFrame) -> tuple[DataFrame, bool]:
    """Labels (node, c, k) of one level's graph after moves until none gains, and whether any node moved.

    All nodes choose at once, so their moves can spoil each other: a share of them moves, by a hash of node and round, and
    the round counts only if the modularity of the whole rose. If no share does, moves that touch no community in common
    (:func:`_apart`) are made, which always raises it, so a level ends when no node gains (1e-12 of modularity or less is
    no gain). A round that counts lets twice the share move in the next. Two figures a round come to the driver."""
    both = written(e.filter("a <> b").unionByName(e.filter("a <> b").selectExpr("b a", "a b", "weight")), "moves-edges")
    label = written(_strengths(e).select("node", F.col("node").alias("c"), "k"), "moves-labels")
    ends = label.agg(F.sum("k")).first()[0]
    sent = F.broadcast if small(label, 150, 32 << 20) else lambda rows: rows  # one row a node at most, or a community
    votes = _votes(both, label, sent)
    quality, moved, idle, turn = _quality(votes, label, ends, sent), False, 0, 0
    better = _better(votes, label, ends, sent)
    while idle <= IDLE and not better.isEmpty():
        turn += 1
        alone = idle == IDLE
        chosen = _apart(better, sent) if alone else better.filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2 << idle)) == 0)
        if chosen.isEmpty():
            idle += 1
            continue
        new = written(label.join(sent(chosen.select("node", "to")), "node", "left").select("node", F.coalesce("to", "c").alias("c"), "k"), "moves-labels")
        new_votes = _votes(both, new, sent)
        now = _quality(new_votes, new, ends, sent)
        if now > quality + 1e-12:
            forget(label, votes, better)
            label, votes, quality, moved, idle = new, new_votes, now, True, max(idle - 1, 0)
            better = _better(votes, label, ends, sent)
        else:
            forget(new, new_votes)
            idle += 1
    forget(both, votes, better)
    return label, moved


def modularity_communities(edges: DataFrame) -> DataFrame:
    """node and community, its smallest node, for every node of ``edges`` (a, b, weight) that has a valid edge.

    Each level moves nodes to the community around them that raises the modularity most, until no round gains; then each
    community becomes a node, its inner weight a loop, and the next level begins. It ends when a level moves nothing.
    The modularity never falls; ties go by id and sums are rounded, so the order of rows does not matter. Repeated edges
    add up, both directions are one edge; null ends and weights of 0 or less are ignored; no edges give no rows."""
    e = written(_simple(edges), "moves-graph")
    whole = None
    moved = not e.isEmpty()
    if not moved:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, community {kind}")
    while moved:
        label, moved = _level(e)
        if whole is None:
            after = written(label.select("node", F.col("c").alias("community")), "moves-whole")
        else:
            after = written(whole.join(label.selectExpr("node community", "c"), "community").select("node", F.col("c").alias("community")), "moves-whole")
        forget(whole)
        whole = after
        if moved:
            of = lambda end: label.select(F.col("node").alias(end), F.col("c").alias(f"c{end}"))  # noqa: E731, B023
            less = written(_simple(e.join(of("a"), "a").join(of("b"), "b").selectExpr("ca a", "cb b", "weight")), "moves-graph")
            forget(e)
            e = less
        forget(label)
    forget(e)
    smallest = whole.groupBy("community").agg(F.min("node").alias("_least"))
    return whole.join(smallest, "community").select("node", F.col("_least").alias("community"))
