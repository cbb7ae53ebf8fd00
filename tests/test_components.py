"""Components of long paths in few rounds, whatever the order of the ids, and scratch tables."""

import random

import pytest

from tidewatch import runtime
from tidewatch.operators import components


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_paths_settle_in_few_rounds(spark, order, monkeypatch):
    ids = list(range(5000))
    if order == "shuffled":
        random.Random(7).shuffle(ids)
    edges = list(zip(ids, ids[1:]))
    edges = [(b, a) for a, b in edges] if order == "descending" else edges
    made = []
    monkeypatch.setattr(components, "written", lambda df, label: made.append(label) or runtime.written(df, label))
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node for r in got} == set(ids) and {r.component for r in got} == {0} and len(got) == 5000
    assert made.count("edges") - 1 < 15 and made.count("hook") < 40


def test_string_nodes_nulls_and_loops(spark):
    rows = [("b", "a"), ("b", "c"), ("x", "x"), (None, "a"), ("y", None), ("z", "y"), ("b", "a")]
    got = components.connected_components(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert {(r.node, r.component) for r in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")} and len(got) == 5


def test_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "scratch_root", lambda _: f"file://{tmp_path}")
    df = runtime.written(spark.range(5), "some")
    assert df.count() == 5 and len(list(tmp_path.iterdir())) == 1
    runtime.forget(df, None)
    runtime.forget(df)
    assert not list(tmp_path.iterdir())
    components.connected_components(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src long, dst long")).collect()
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["label"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        runtime.scratch_root(Session)
