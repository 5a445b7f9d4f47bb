"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no component is gathered in a task. The centre of
a large star is dealt over ``SALT`` parts by its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import stored

SALT = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours in ``pairs``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("lu"), F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
    return salted.join(least, (F.col("u") == F.col("lu")) & (F.col("salt") == F.col("part"))).select("u", "v", "m")


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of longs, any order, repeats and loops allowed. Returns (node, component):
    the smallest node that can be reached, for every node with an edge to another one."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(down)
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
