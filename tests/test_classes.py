"""Items with equal keyword sets are one class: as many links as sets allow, and the results of all pairs."""

import itertools

from pyspark.sql import functions as F

from tidewatch.operators.clusters import class_communities, class_graph, class_links, communities, keyword_classes, keyword_pairs
from tidewatch.operators.communities import modularity, modularity_communities
from tidewatch.operators.components import connected_components

SETS = [["a", "b", "c"], ["c", "b", "a"], ["a", "b", "d"], ["b", "d", "e"], ["x", "y"], ["x", "z", "y"], ["q"], None]


def table(spark, copies):
    rows = [(f"i{c:02}{n}", "one" if n % 2 else "two", s) for c in range(copies) for n, s in enumerate(SETS)]
    rows += [("null-1", None, ["a"]), ("null-2", None, ["a"])]
    return spark.createDataFrame(rows, "id string, category string, keywords array<string>")


def dicts(df):
    return {r.node: r.community for r in df.collect()}


def test_links_grow_with_items_not_with_pairs(spark):
    for copies in (3, 12):
        items = table(spark, copies)
        links = class_links(*keyword_classes(items, "id", 0.2, ["category"])).collect()
        near = {(r.a, r.b) for r in links if r.jaccard < 1}
        assert len(near) == 2 and len(links) - len(near) == 7 * (copies - 1)  # a pair of sets in each category, and members
    plain = keyword_pairs(table(spark, 3), "id", 0.2, ["category"])
    assert plain.count() == 7 * 3 + 2 * 9
    few, all_ = (dict(connected_components(e, "a", "b").collect()) for e in (class_links(*keyword_classes(table(spark, 3), "id", 0.2, ["category"])), plain))
    assert few == all_


def test_communities_and_modularity_as_of_all_pairs(spark):
    items = table(spark, 4)
    edges = keyword_pairs(items, "id", 0.2, ["category"]).select("a", "b", F.col("jaccard").alias("weight"))
    near, members = keyword_classes(items, "id", 0.2, ["category"])
    for rounds in (1, 2, 5):
        assert dicts(class_communities(near, members, rounds)) == dicts(communities(edges, rounds))
    label = class_communities(near, members)
    whole, small = (modularity(e, label).first()[0] for e in (edges, class_graph(near, members)))
    assert abs(whole - small) < 1e-12
    found = modularity_communities(class_graph(near, members)).withColumnRenamed("node", "rep")
    spread = dicts(members.join(found, "rep").select(F.col("id").alias("node"), "community"))
    assert spread == dicts(modularity_communities(edges)) and not any(v.startswith("null") for v in spread)
