"""E4 and E7_topic_clusters run over the plain vectors, with pairs from 0.25 and 0.38 on."""

from tidewatch import catalog


def test_pairs_from_a_quarter_on(spark):
    weights = [r.weight for r in catalog.queries()["E4_similarity_edges"](spark, "/root/testdata/sf0.001").collect()]
    assert weights and 0.25 <= min(weights) < 0.38
    sql = catalog.oracle_sql()
    assert "weight >= 0.25" in sql["E4_similarity_edges"] and "weight >= 0.38" in sql["E7_topic_clusters"]
