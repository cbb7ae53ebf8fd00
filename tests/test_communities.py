"""Communities by modularity: planted ones are found, no single move gains, never below label propagation, any row order."""

import itertools
import random

import pytest

from tidewatch.operators.clusters import communities
from tidewatch.operators.communities import modularity, modularity_communities

SCHEMA = "a string, b string, weight double"


def quality(edges, label):
    """Modularity by its definition, from a dict of labels."""
    total = 2 * sum(w for _, _, w in edges)
    inner = sum(2 * w for a, b, w in edges if label[a] == label[b])
    ends = {}
    for a, b, w in edges:
        for v in (a, b):
            ends[label[v]] = ends.get(label[v], 0) + w
    return inner / total - sum((s / total) ** 2 for s in ends.values())


def found(spark, edges):
    return {r.node: r.community for r in modularity_communities(spark.createDataFrame(edges, SCHEMA)).collect()}


def ring(cliques, size):
    """Cliques in a ring, each linked to the next by one edge."""
    edges = [(f"{c:02}-{i}", f"{c:02}-{j}", 1.0) for c in range(cliques) for i, j in itertools.combinations(range(size), 2)]
    return edges + [(f"{c:02}-0", f"{(c + 1) % cliques:02}-1", 1.0) for c in range(cliques)]


def noisy():
    draw = random.Random(3)
    nodes = [f"n{i:02}" for i in range(40)]
    return [(a, b, draw.choice((0.5, 1.0))) for a, b in itertools.combinations(nodes, 2) if draw.random() < (0.7 if int(a[1:]) % 4 == int(b[1:]) % 4 else 0.06)]


def test_planted_cliques(spark):
    label = found(spark, ring(5, 5))
    assert label == {v: v[:3] + "0" for v in label} and len(label) == 25


def test_noisy_groups_whatever_the_order(spark):
    edges = noisy()
    label = found(spark, edges)
    assert {frozenset(v for v in label if label[v] == c) for c in set(label.values())} == {frozenset(f"n{i:02}" for i in range(r, 40, 4)) for r in range(4)}
    turned = [(b, a, w) for a, b, w in edges]
    random.Random(1).shuffle(turned)
    assert found(spark, turned) == label
    spread = {r.node: r.community for r in communities(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert quality(edges, label) >= quality(edges, spread)
    for v, c in itertools.product(label, set(label.values())):
        assert quality(edges, label | {v: c}) <= quality(edges, label) + 1e-9
    got = modularity(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame(list(label.items()), "node string, community string")).first()[0]
    assert got == pytest.approx(quality(edges, label))


def test_star_pair_loops_nulls_repeats(spark):
    edges = [("hub", f"s{i}", 1.0) for i in range(9)] + [("p", "q", 1.0), ("q", "p", 2.0), ("p", "p", 0.5), ("x", "y", 0.0), (None, "p", 1.0), ("lone", "lone", 1.0)]
    label = found(spark, edges)
    assert {v for v in label if label[v] == "hub"} == {"hub", *(f"s{i}" for i in range(9))}
    assert label["p"] == label["q"] == "p" and label["lone"] == "lone" and "x" not in label
    assert found(spark, []) == {} and modularity(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "node string, community string")).first()[0] is None
