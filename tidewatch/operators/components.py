"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import forget, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label every node that has an edge with the smallest node of its component: ``(node, component)``.

    Each round every node picks its smallest neighbour, larger or not. Picks run along ever smaller edges into a pair
    that picked each other, whose smaller node is the smallest of the tree; pointers are followed until all nodes point
    to it, and the edges contracted. Every tree has two nodes or more, so a round at least halves the nodes: both loops
    are logarithmic and run until nothing is left, also on long paths. The hub of a star is pre-aggregated map-side.
    Nulls and self loops are ignored; repeated edges count once. An empty table gives an empty table. Only whether
    anything is left comes to the driver.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    e = written(e.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    label = None
    while not e.isEmpty():
        both = e.unionByName(e.selectExpr("b a", "a b"))
        pick = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")), "pick")
        # the pick's pick is v itself where two picked each other: the smaller one is the root
        hook = written(pick.join(pick.selectExpr("v m", "m g"), "m").selectExpr("v", "least(m, g) m", "true moved"), "hook")
        forget(pick)
        moved = True
        while moved:
            step = hook.selectExpr("v m", "m g")  # two steps a table: a path to the root shrinks to a third
            twice = hook.select("v", "m").join(step, "m").selectExpr("v", "m as was", "g as m").join(step, "m")
            after = written(twice.selectExpr("v", "g m", "g <> was moved"), "hook")
            forget(hook)
            hook, moved = after, not after.filter("moved").isEmpty()
        if label is None:
            after = written(hook.selectExpr("v node", "m component"), "label")
        else:
            after = written(label.join(hook, label.component == hook.v, "left").select("node", F.coalesce("m", "component").alias("component")), "label")
        forget(label)
        left, right = hook.selectExpr("v a", "m ma"), hook.selectExpr("v b", "m mb")
        less = e.join(left, "a").join(right, "b").filter("ma <> mb").selectExpr("least(ma, mb) a", "greatest(ma, mb) b").distinct()
        less = written(less, "edges")
        forget(e, hook)
        e, label = less, after
    forget(e)
    if label is None:
        kind = edges.schema[src].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return label
