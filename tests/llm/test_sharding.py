import random

import pytest

from labelloop.llm import queries, sharding
from tests.conftest import SF001, SF0001
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose, table

FIELDS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def test_odd_rows(spark, odd, none):
    rows = [r[:2] for r in odd_rows()]
    assert table(sharding.shard_documents(odd), *FIELDS) == sorted(brute.shards(rows), key=str)
    assert table(sharding.shard_documents(odd, 3), *FIELDS) == sorted(brute.shards(rows, 3), key=str)
    assert table(sharding.shard_documents(none), *FIELDS) == []
    with pytest.raises(ValueError):
        sharding.shard_documents(odd, 0)


def test_turns_equal_a_heap_of_single_groups():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        slow = fast = [(0, s) for s in range(n)]
        slow, fast = list(slow), list(fast)
        for weight in sorted(rng.sample(range(1, 60), rng.randint(1, 12)), reverse=True):
            count = rng.choice((1, 1, 2, 5, 40))
            want = []
            for _ in range(count):
                load, s = min(slow)
                slow.remove((load, s))
                slow.append((load + weight, s))
                want.append(s)
            phases = list(sharding.turns(fast, weight, count))
            got = [[t[(i - a) % len(t)] for a, t in phases if a <= i][-1] for i in range(count)]
            assert got == want and sorted(fast) == sorted(slow)
            assert len(phases) <= n


def test_a_hot_text_and_many_of_one_weight(spark):
    """One text holds a third of all rows, another third has one length; nothing is dropped."""
    rng = random.Random(6)
    hot = prose(rng, 12)
    rows = [(i, hot) for i in range(200)] + [(1000 + i, "".join(rng.choice("abcdef") for _ in range(9))) for i in range(200)]
    rows += [(2000 + i, prose(rng, rng.randint(1, 90))) for i in range(200)] + [(None, hot), (5, hot), (5, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert table(sharding.shard_documents(docs), *FIELDS) == sorted(brute.shards(rows), key=str)


def test_loads_are_near_equal_on_the_test_table(spark):
    rows = queries.QUERIES["op11_sharding"](spark, SF001).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in rows), key=str) == sorted(brute.shards(docs), key=str)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(r["size"] for r in rows)


def test_written_shards_keep_all_columns(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd.withColumnRenamed("size", "shard"), path, 4)
    out = spark.read.parquet(path)
    assert set(out.columns) == {*odd.columns, "shard", "shard_"} - {"size"}
    assert table(out, "doc_id", "text", "shard_") == sorted(
        ((i, t, s) for (i, t), s in zip([r[:2] for r in odd_rows()], _shards_of(4), strict=True)), key=str)


def _shards_of(n):
    rows = [r[:2] for r in odd_rows()]
    by = {(size, crc): shard for _, size, crc, _, shard, _, _ in brute.shards(rows, n)}
    import zlib
    return [by[len((t or "").encode()) + 1, zlib.crc32((t or "").encode())] for _, t in rows]


def test_sharding_sql(spark):
    assert queries.QUERIES["op11_sharding"](spark, SF0001).columns == list(FIELDS)
