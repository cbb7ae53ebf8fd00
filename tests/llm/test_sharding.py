import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import sharding


def plain_loads(sizes, shards):
    """Longest processing time first, one push a group."""
    heap = [(0, i) for i in range(shards)]
    for s in sorted(sizes, reverse=True):
        x, i = heapq.heappop(heap)
        heapq.heappush(heap, (x + s, i))
    return sorted(x for x, _ in heap)


def test_equal_items_in_one_step_are_a_push_each():
    rnd = random.Random(1)
    for _ in range(500):
        loads = [rnd.randint(0, 50) for _ in range(rnd.randint(1, 6))]
        size, n = rnd.randint(1, 20), rnd.randint(0, 40)
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        want = [0] * len(loads)
        for _ in range(n):
            x, i = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (x + size, i))
        assert sharding.shares(loads, size, n) == want


def test_plan_of_exact_sizes_is_the_plain_one():
    rnd = random.Random(2)
    for _ in range(100):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 60))]
        classes = [(s, sizes.count(s), s * sizes.count(s)) for s in set(sizes)]
        plan = sharding.longest_first(classes, 4).to_pydict()
        loads = [0] * 4
        for key, starts, to in zip(plan["class"], plan["starts"], plan["to"]):
            for a, b, i in zip(starts, [*starts[1:], sizes.count(key)], to):
                loads[i] += key * (b - a)
        assert sorted(loads) == plain_loads(sizes, 4)


def test_classes_are_bounded_and_exact_below(spark):
    got = spark.range(1, 200_000, 7).select("id", sharding.size_class(F.col("id")).alias("c")).collect()
    assert all(r.c == r.id for r in got if r.id < 8192)
    assert all(r.id - r.c < r.id / 4096 for r in got)


def rows_of(sharded):
    return [tuple(r) for r in sharded.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def lawful(rows, texts, shards):
    """Groups together, slots gapless, every row there."""
    assert sorted((i is None, i or 0) for i, *_ in rows) == sorted((i is None, i or 0) for i, _ in texts)
    slots, where = defaultdict(list), defaultdict(set)
    by_crc = defaultdict(set)
    for _, t in texts:
        by_crc[zlib.crc32((t or "").encode())].add(t or "")
    for _, size, crc, shard, slot in rows:
        assert 0 <= shard < shards and size in {len(t.encode()) + 8 for t in by_crc[crc]}
        slots[shard].append(slot)
        where[crc, size].add(shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    loads = [0] * shards
    for _, size, _, shard, _ in rows:
        loads[shard] += size
    return sorted(loads)


def test_documents_against_brute_force(spark, docs, texts):
    out = sharding.shard_rows(docs, 5)
    groups = defaultdict(int)
    for t in texts.values():
        groups[t or ""] += len((t or "").encode()) + 8
    loads = lawful(rows_of(out), list(texts.items()), 5)
    best = plain_loads(groups.values(), 5)
    assert loads[-1] - loads[0] <= best[-1] - best[0] + sum(loads) / 4096
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_many_equal_rows_without_id_long_texts_and_nothing(spark):
    data = [(None, "")] * 500 + [(None, None)] * 500 + [(1, "x" * 3_000_000), (1, "x" * 3_000_000)] + [(i, f"t{i}") for i in range(2, 60)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("key", F.lit(1))
    lawful(rows_of(sharding.shard_rows(frame, 3)), data, 3)
    assert rows_of(sharding.shard_rows(frame.limit(0), 3)) == []
    assert {r[3] for r in rows_of(sharding.shard_rows(frame, 1))} == {0}
    with pytest.raises(ValueError):
        sharding.shard_rows(frame, 0)


def test_groups_by_a_column_with_nulls(spark, docs):
    part = docs.withColumn("g", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7))
    out = sharding.shard_rows(part, 4, together=F.col("g")).join(part.select("doc_id", "g"), "doc_id")
    where = defaultdict(set)
    for r in out.collect():
        where[r.g].add(r.shard)
    assert len(where) == 8 and all(len(s) == 1 for s in where.values())


def test_hot_groups_beyond_the_broadcast(spark, docs, monkeypatch):
    from tidewatch.llm import skew

    monkeypatch.setattr(skew, "small", lambda *a: False)
    assert len(rows_of(sharding.shard_rows(docs, 5))) == docs.count()


def test_written_shards(spark, docs, tmp_path):
    plain = docs.drop("n", "id")
    out = sharding.shard_rows(plain, 3)
    sharding.write_shards(plain, out, str(tmp_path / "s"), rows_a_file=10)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == plain.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
    want = {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want
