"""Every registered query with SQL equals DuckDB over the smallest tables, the others give rows; streams equal batches."""

import glob
import os

import duckdb
import pytest

from tidewatch import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert df.columns
        return
    got = duck.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    want = sorted(([plain(r[columns.index(c)]) for c in order] for r in got.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in order] for r in rows), key=repr) == want


def test_order_of_rows_does_not_matter(spark):
    from tidewatch.adapters import AS_OF, Tables
    from tidewatch.plans.pipeline import article_pipeline

    a = Tables(spark, SF).articles.limit(80)
    one, two = (article_pipeline(x, AS_OF).select("group_id", "article_count", "score", "title").orderBy("group_id").collect() for x in (a, a.orderBy("title").repartition(5)))
    assert one == two and all(0 <= r.score <= 100 for r in one)


def test_pipeline_stream(spark, tmp_path):
    from tidewatch.adapters import AS_OF, Tables
    from tidewatch.plans.pipeline import article_pipeline
    from tidewatch.streaming.streams import start_pipeline

    a = Tables(spark, SF).articles.limit(40)
    a.write.parquet(str(tmp_path / "in"))
    start_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), a.schema, lambda: AS_OF).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("group_id", "score").orderBy("group_id").collect()
    assert got == article_pipeline(a, AS_OF).select("group_id", "score").orderBy("group_id").collect()


def test_pipeline_stream_over_two_batches(spark, tmp_path):
    import datetime as dt

    from tidewatch.adapters import AS_OF
    from tidewatch.streaming.streams import newest_groups, start_pipeline

    schema = "article_id long, url string, title string, body string, source string, locale string, category string, publish_time timestamp"
    at = dt.datetime(2024, 1, 30, 23)
    flood, comet = "river flood valley bridge rescue", "comet telescope orbit tail astronomer"

    def row(i, words, url=None, more=""):
        return (i, url or f"https://a.example/{i}", words, f"{words} {words} {words}{more}", f"s{i}", "en", "general", at + dt.timedelta(minutes=i))

    first = [row(1, flood), row(2, flood, more=" once"), row(3, comet)]
    second = [
        row(4, flood, more=" twice"),  # of the group that is there
        row(5, "harvest grain tractor field barn", "https://a.example/1"),  # a known url
        row(6, comet),  # a known text
        row(7, "opera tenor stage chorus violin"),  # a group of its own
        row(8, "funeral obituary mourners chapel wreath"),  # off topic
    ]
    ran = []
    for name, parts in (("two", (first, second)), ("one", (first + second,))):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            paths = [str(tmp_path / name / x) for x in ("in", "out", "state")]
            start_pipeline(spark, *paths, spark.createDataFrame([], schema).schema, lambda: AS_OF, off_topic=("funeral", "obituary")).awaitTermination()
        rows = spark.read.parquet(paths[1])
        ran.append({r.group_id: (r.article_count, r.source_count) for r in newest_groups(rows).collect()})
        if name == "two":
            assert {(r.group_id, r.batch) for r in rows.collect()} == {(1, 0), (3, 0), (1, 1), (7, 1)}
            scores = [r.score for r in rows.filter("group_id = 1").orderBy("batch").collect()]
            assert scores[1] >= scores[0]
    assert ran[0] == ran[1] == {1: (3, 3), 3: (1, 1), 7: (1, 1)}


def test_pipeline_stream_forgets_after_a_week_and_reads_only_recent_days(spark, tmp_path):
    """A url of the first day is dropped on the fifth and new again after the seventh; a repeated batch is the same."""
    import datetime as dt
    import os
    import shutil

    from tidewatch.streaming.streams import start_pipeline

    schema = "article_id long, url string, title string, body string, source string, locale string, category string, publish_time timestamp"
    now = dt.datetime(2024, 1, 1, 12)
    words = ["river flood valley bridge rescue", "comet telescope orbit tail astronomer", "harvest grain tractor field barn", "opera tenor stage chorus violin"]
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]

    def run(day, rows):
        at = now + dt.timedelta(days=day)
        made = [(i, f"https://a.example/{u}", words[w], f"{words[w]} {words[w]} {words[w]}", f"s{i}", "en", "general", at) for i, u, w in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(paths[0])
        start_pipeline(spark, *paths, spark.createDataFrame([], schema).schema, lambda: str(at)).awaitTermination()

    read = lambda: sorted((r.group_id, r.article_count, str(r.day), r.batch) for r in spark.read.parquet(paths[1]).collect())
    run(0, [(1, "a", 0)])
    run(5, [(2, "a", 1), (3, "b", 2)])  # a known url
    assert read() == [(1, 1, "2024-01-01", 0), (3, 1, "2024-01-06", 1)]
    shutil.rmtree(f"{paths[1]}/day=2024-01-01")  # not read any more
    run(8, [(4, "a", 3), (5, "b", 0)])  # the first is forgotten, the second is not
    assert read() == [(3, 1, "2024-01-06", 1), (4, 1, "2024-01-09", 2)]
    for name in ("2", ".2.crc"):  # as if the run had ended before it could commit
        os.remove(f"{paths[2]}/commits/{name}")
    now += dt.timedelta(days=40)  # a repeat on another day has the time of the first attempt
    start_pipeline(spark, *paths, spark.createDataFrame([], schema).schema, lambda: str(now)).awaitTermination()
    assert read() == [(3, 1, "2024-01-06", 1), (4, 1, "2024-01-09", 2)]


def test_without_the_llm_package(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
