"""Sharding by longest-processing-time scheduling (operator 11).

Rows with equal texts are a group that must stay together; its weight is the sum of its rows' sizes
(UTF-8 bytes and one). Groups go by falling weight, equal weights by the SHA-256 of their text, each
to the shard that holds least, equal loads to the lower shard number.

Groups of one weight are interchangeable for the loads, so the heap runs over the distinct weights
with their counts, and gives each weight at most ``n_shards`` phases: from which rank on, and the
shards that take turns. Distinct weights add up to no more than the corpus, so there are at most
sqrt(2 x bytes) of them (about 14 million for 100 TB, some ten thousand for 1 GB); one task streams
them in order with the loads as its only state. Groups are ranked by a distributed sort, and rows
meet their group's shard in a salted join; a text that occurs once needs none.

Nulls: a null text is an empty text (size 1, checksum 0) and in its group. Null ids, repeated ids
and repeated rows are rows like others, one result each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import documents, sql_crc32, stored, tidied, unused
from labelloop.llm.components import SALT
from labelloop.sources.tables import numbered

_PHASES = "array<struct<first: bigint, turns: array<int>>>"


def turns(heap: list[tuple[int, int]], weight: int, count: int) -> Iterator[tuple[int, list[int]]]:
    """Give ``count`` groups of ``weight`` to the least loaded of ``heap`` (load, shard), changed in
    place: (rank of the first group, shards that take turns from there on).

    The shards that come before the first one comes again are a round. Rounds repeat, in the same
    order, until the next shard outside is due within one."""
    at = 0
    while at < count:
        first = heappop(heap)
        shards = [first]
        while heap and heap[0] < (first[0] + weight, first[1]):
            shards.append(heappop(heap))
        left = count - at
        rounds, rest = divmod(left, len(shards))
        if heap:
            load, shard = heap[0]
            most, even = divmod(load - first[0], weight)
            most -= not even and shard < first[1]
            if most <= rounds:
                rounds, rest = most, 0
        yield at, [s for _, s in shards]
        for i, (load, shard) in enumerate(shards):
            heappush(heap, (load + weight * (rounds + (i < rest)), shard))
        at += rounds * len(shards) + rest


def schedule(weights: DataFrame, n_shards: int) -> DataFrame:
    """``weights`` (weight, n, first): distinct weights, how many groups have it, the rank of the
    first of them. Returns (weight, phases), the ranks counted over all groups."""
    def run(batches):
        heap = [(0, s) for s in range(n_shards)]
        for batch in batches:
            w, n, first = (batch.column(c).to_pylist() for c in ("weight", "n", "first"))
            phases = [[{"first": f + at, "turns": t} for at, t in turns(heap, a, b)] for a, b, f in zip(w, n, first, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("weight"), pa.array(phases, pa.list_(pa.struct([("first", pa.int64()), ("turns", pa.list_(pa.int32()))])))], ["weight", "phases"])
    return weights.repartition(1).sortWithinPartitions(F.desc("weight")).mapInArrow(tidied(run), f"weight long, phases {_PHASES}")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = documents(df, id_col, text_col)
    return docs.select("doc_id", (F.octet_length("text") + F.lit(1).cast("long")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                       F.unhex(F.sha2("text", 256)).alias("key"), F.monotonically_increasing_id().alias("row"))


def placed_groups(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (key, size, ...) in groups by key: key, n, weight, rank, shard, and the least of the
    other columns, which are those of the row where there is one only."""
    if n_shards < 1:
        raise ValueError("there must be a shard")
    rest = [c for c in rows.columns if c != "key"]
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in rest)).withColumn("weight", F.col("n") * F.col("size"))
    ranked = numbered(groups.orderBy(F.desc("weight"), "key"), "rank", 0, "shard-groups")
    weights = ranked.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    phases = schedule(weights, n_shards).select(F.col("weight").alias("of_weight"), "phases", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    phase = F.expr("element_at(filter(phases, p -> p.first <= rank), -1)")
    return (ranked.join(phases, (F.col("weight") == F.col("of_weight")) & (F.col("rank") % SALT == F.col("part")))
            .withColumn("phase", phase)
            .withColumn("shard", F.expr("element_at(phase.turns, cast((rank - phase.first) % size(phase.turns) as int) + 1)"))
            .drop("of_weight", "part", "phases", "phase"))


def _met(rows: DataFrame, groups: DataFrame, spread: str) -> DataFrame:
    """``rows`` with the shard of their key; the rows of one key are dealt over ``SALT`` parts."""
    keys = groups.select(F.col("key").alias("of_key"), "shard", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    return salted.join(keys, (F.col("key") == F.col("of_key")) & (F.col("salt") == F.col("part"))).drop("of_key", "salt", "part")


def shard_documents(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, size, text_crc32, law (``bytes``), shard, slot (0, 1,
    ... within the shard by id, null first, then by text), grown_shard (null: only laws by key have
    one)."""
    rows = stored(_keyed(df, id_col, text_col), "shard-rows")
    groups = stored(placed_groups(rows, n_shards), "shard-placed")
    columns = ["doc_id", "size", "text_crc32", "key", "row", "shard"]
    single = groups.filter("n = 1").select(*columns)
    several = _met(rows, groups.filter("n > 1"), "row").select(*columns)
    ordered = numbered(single.union(several).orderBy("shard", "doc_id", "key", "row"), "at", 0, "shard-slots")
    starts, at = F.lit(None).cast("long"), 0
    for shard, n in sorted(ordered.groupBy("shard").count().collect()):  # n_shards rows
        starts = F.when(F.col("shard") == shard, F.lit(at).cast("long")).otherwise(starts)
        at += n
    return ordered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - starts).alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all columns of ``df`` under ``path``, a folder for each shard. A shard's rows are
    spread over files by id, so that no task holds a shard."""
    shard = unused(df, "shard")
    rows = stored(_keyed(df, id_col, text_col).drop("doc_id", "text_crc32"), "shard-rows")
    groups = stored(placed_groups(rows, n_shards), "shard-placed").withColumnRenamed("shard", shard)
    held = [unused(df, c) for c in ("shard_key", "shard_salt", "shard_part", "shard_of")]
    keys = groups.select(F.col("key").alias(held[3]), shard, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(held[2]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = (df.withColumns({held[0]: F.unhex(F.sha2(text, 256)), held[1]: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT)).cast("int")})
           .join(keys, (F.col(held[0]) == F.col(held[3])) & (F.col(held[1]) == F.col(held[2]))).drop(*held))
    out.repartitionByRange(F.col(shard), F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(shard, id_col).write.partitionBy(shard).parquet(path)


# One group after the other, each to the first of the least loaded of eight shards.
SHARDING_SQL = f"""
WITH RECURSIVE g AS MATERIALIZED (
  SELECT t, n * (strlen(t) + 1) AS weight, row_number() OVER (ORDER BY n * (strlen(t) + 1) DESC, sha256(t)) AS r, {sql_crc32("t")} AS crc
  FROM (SELECT coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY 1)),
lpt(r, loads, shard) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT
  UNION ALL
  SELECT g.r, list_transform(loads, lambda l, i: CASE WHEN i = first THEN l + g.weight ELSE l END), first - 1
  FROM (SELECT r, loads, list_position(loads, list_min(loads)) AS first FROM lpt) x JOIN g ON g.r = x.r + 1)
SELECT d.doc_id, CAST(strlen(g.t) + 1 AS BIGINT) AS size, g.crc AS text_crc32, 'bytes' AS law, CAST(lpt.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY lpt.shard ORDER BY d.doc_id NULLS FIRST, sha256(g.t)) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM documents d JOIN g ON g.t = coalesce(d.text, '') JOIN lpt ON lpt.r = g.r
"""
