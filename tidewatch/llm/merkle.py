"""A Merkle manifest of a dataset by time-forward processing.

Nodes are labelled from the leaves up, so a node's label lies above those of its children. A sweep over ascending labels
sends each digest to the parent, through a queue ordered by the receiver's label; the reversed sweep sends to each child
its proof: its siblings, and what its parent was sent. The queue is external in two parts. Inside a block, a subtree of
up to 8 to the 4th nodes, it is a heap; between blocks it is the shuffle, which brings what a block is sent
together. A block is one small group, whatever the size of the tree, and the nodes of a round are a 4096th of those of
the round before.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.runtime import forget, maybe_broadcast, shipped, written

#: Children of a node, and levels of a block.
FANOUT, HEIGHT = 8, 4
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenation."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` if null, else the UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return digest(*(encoded(f) for f in fields))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def siblings(proof: Column) -> Column:
    """Digest of all siblings, from the leaf's run up to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def sweep_up(leaves: list[str], total: int, most: int = HEIGHT) -> list[list[str]]:
    """Levels of digests of a block, leaves first, up to one node or ``most`` levels. ``total``: nodes of the leaves'
    level in the whole tree; a tree of one node has no parent.

    A queue of (receiver's label, child, digest), ordered by label; a node takes what is at the front for it."""
    levels, height = [leaves], 0
    while total > 1 and height < most:
        total, height = -(-total // FANOUT), height + 1
    levels += [[] for _ in range(height)]
    queue = [(1, i // FANOUT, i, h) for i, h in enumerate(leaves)] if height else []  # ascending: a heap as it is
    while queue:
        level, node, _, _ = queue[0]
        parts = []
        while queue and queue[0][:2] == (level, node):
            parts.append(heapq.heappop(queue)[3])
        h = sha256("".join(parts).encode()).hexdigest()
        levels[level].append(h)
        if level < height:
            heapq.heappush(queue, (level + 1, node // FANOUT, node, h))
    return levels


def sweep_down(levels: list[list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Proofs of a block's leaves: (before, after) by level, to ``above``, the proof of the block's top.

    The queue holds (receiver's label, proof), highest label first; a node sends its children theirs."""
    out: list[list[tuple[str, str]]] = [above] * len(levels[0])
    queue = [(1 - len(levels), 0, above)]
    while queue:
        level, node, proof = heapq.heappop(queue)
        level, node = -level, -node
        if not level:
            out[node] = proof
            continue
        first = node * FANOUT
        run = levels[level - 1][first : first + FANOUT]
        for k in range(len(run)):
            own = ("".join(run[:k]), "".join(run[k + 1 :]))
            heapq.heappush(queue, (1 - level, -(first + k), [own, *proof]))
    return out


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``at``, the place in its tree from 0, and ``total``, the tree's rows.

    Rows are dealt by range of (tree, order) and counted by task; a row's place is its place in the task after the rows
    of the tasks before. So a tree with all rows is spread over tasks, and the table of starts has at most as many rows
    as there are tasks and trees."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order).withColumn("row", F.monotonically_increasing_id())
    ranged = written(ranged, "merkle-ranged")
    part = F.shiftright("row", 33)
    counts = ranged.groupBy(tree, part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    w = Window.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(tree).alias("of"), F.col("part").alias("in"), (before - F.col("first")).alias("start"), F.sum("n").over(w).alias("total"))
    starts = written(starts, "merkle-starts")
    known = (F.col(tree) == F.col("of")) & (part == F.col("in"))
    out = ranged.join(maybe_broadcast(starts, 64), known).withColumn("at", F.col("row") + F.col("start"))
    return out.select(*rows.columns, "at", "total")


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """tree, at, total and digest of the tops of all blocks of ``nodes`` (tree, at, total, digest)."""

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        total = int(part["total"].iloc[0])
        levels = sweep_up(part["digest"].tolist(), total, height)
        for _ in levels[1:]:
            total = -(-total // FANOUT)
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "at": [int(part["at"].iloc[0]) // FANOUT**height], "total": [total], "digest": [levels[-1][0]]})

    kind = nodes.schema["tree"].dataType.simpleString()
    blocks = nodes.withColumn("block", F.floor(F.col("at") / FANOUT**height)).groupBy("tree", "block")
    return blocks.applyInPandas(top, f"tree {kind}, at long, total long, digest string")


def _down(nodes: DataFrame, tops: DataFrame, height: int) -> DataFrame:
    """``nodes`` (tree, at, total, digest, more) with ``proof``; ``tops``: tree, at and proof of their blocks' tops."""

    def proofs(key: tuple, part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=[*columns, "proof"])
        part = part.sort_values("at")
        above = [(p["before"], p["after"]) for p in top["proof"].iloc[0]]
        found = sweep_down(sweep_up(part["digest"].tolist(), int(part["total"].iloc[0]), height), above)
        return part.assign(proof=[[{"before": b, "after": a} for b, a in p] for p in found])[[*columns, "proof"]]

    columns = nodes.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    left = nodes.withColumn("block", F.floor(F.col("at") / FANOUT**height)).groupBy("tree", "block")
    return left.cogroup(tops.withColumn("block", F.col("at")).groupBy("tree", "block")).applyInPandas(proofs, f"{shape}, proof {PROOF}")


def prove(nodes: DataFrame, label: str = "merkle", height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """For ``nodes`` (tree, at, total, digest and more; a written table): tree and ``digest`` of each tree's top, and
    ``finish(tops)`` to call with the tops' proofs (tree, proof), which gives ``nodes`` with ``proof``.

    Rounds of blocks go on until each tree is one node: one for each factor of FANOUT ** ``height`` in the largest tree."""
    shipped(nodes.sparkSession)
    rounds = [nodes]
    while not (last := rounds[-1]).filter("total > 1").isEmpty():
        rounds.append(written(_up(last.select("tree", "at", "total", "digest"), height), label))
    tops = rounds[-1].select("tree", "digest")

    def finish(proofs: DataFrame) -> DataFrame:
        found = proofs.select("tree", F.lit(0).cast("long").alias("at"), "proof")
        for n, level in enumerate(reversed(rounds[:-1]), 1):
            found = _down(level, found, height)
            if n < len(rounds) - 1:
                found = written(found.select("tree", "at", "proof"), label)
        if len(rounds) == 1:  # every tree is a lone leaf
            found = nodes.join(proofs.select(F.col("tree").alias("of"), "proof"), F.col("tree") == F.col("of")).drop("of")
        return found

    return tops, finish


def merkle_manifest(leaves: DataFrame, tree: str = "lang", id_col: str = "doc_id", leaf: str = "leaf", carry: tuple[str, ...] = (), height: int = HEIGHT) -> DataFrame:
    """One row per row of ``leaves``: id, ``leaf``, ``subroot``, ``root`` and ``proof``, and the columns of ``carry``.

    The leaves of a tree ascend by id (nulls first; rows that share an id by leaf, and equal rows are all leaves). While
    several nodes remain, every FANOUT consecutive ones become their digest, the last run also if it is shorter, or one
    node. Subroots, by tree (null first, bytewise), likewise give the root. ``proof`` has, from the leaf up, the siblings
    ``before`` and ``after`` in each run, so that :func:`fold` gives the root again. Other columns are ignored whatever
    their names. An empty table gives an empty table.

    No task holds more than one block of FANOUT ** ``height`` nodes; a tree with all leaves is as many blocks as it needs."""
    extra = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # in the order of the trees, null first
    rows = leaves.select(key.alias("tree"), F.col(id_col).alias("id"), F.col(leaf).alias("digest"), *extra)
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")  # so that equal rows can be dealt apart
    nodes = written(positions(rows, "tree", ["id", "digest", "tie"]), "merkle-nodes")
    tops, finish = prove(nodes, "merkle-round", height)
    forest = written(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-subroots")
    forest = written(positions(forest, "tree", ["name"]), "merkle-forest")
    root, finish_forest = prove(forest, "merkle-forest-round", height)
    nothing = root.select("tree", F.from_json(F.lit("[]"), PROOF).alias("proof"))
    sub = written(finish_forest(nothing).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "proof"), "merkle-tops")
    one = root.first()

    subroots = maybe_broadcast(sub.select(F.col("tree").alias("of"), "subroot"), 96)
    out = finish(sub.select("tree", "proof")).join(subroots, F.col("tree") == F.col("of"))
    forget(rows)
    root = F.lit(one["digest"] if one else None).cast("string").alias("root")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", root, "proof", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
