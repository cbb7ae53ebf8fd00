"""Registered queries against SQL over the smallest tables, or their contract's laws."""

import duckdb
import pytest

from tidewatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,table", [("op12_hard_negatives", "embeddings"), ("op13_merkle_manifest", "documents"), ("op4_exact_dedup", "documents"), ("op10_licence_scan", "documents")])
def test_equals_sql(spark, name, table):
    df = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_shards_of_the_documents(spark):
    rows = queries.op11_sharding(spark, SF).collect()
    assert len(rows) == 200 and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    loads = [sum(r["size"] for r in rows if r.shard == i) for i in range(24)]
    largest = max(r["size"] for r in rows)
    assert max(loads) - min(loads) <= largest
    for i in range(24):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(sum(r.shard == i for r in rows)))
