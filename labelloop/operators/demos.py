"""Demonstration pool construction (L4): per-class clustering of the trusted
rows (A9), cluster means (A10), medoids (A11), per-class retrieval for every row
(J2, W3, J9) and the concatenated per-row demo lists (A12).

Clustering is one Lloyd loop over all classes, one aggregate by (class, cluster)
an iteration. ``k`` is capped by the number of distinct vectors in the class
(quirk 5). Everything after it
works on all classes at once: ``Summarizer.mean`` per (class, cluster) with
partial aggregation, ``min_by`` for the medoid, and the broadcast per-class kNN
of ``retrieve.knn_topk`` for the lists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.functions.vectors import as_double, hash_unit, l2_distance
from labelloop.operators.retrieve import knn_topk
from labelloop.session import stored

Clusterer = Callable[[DataFrame, int], DataFrame]


OVERSAMPLING = 2     # centres drawn in a seeding pass, in multiples of k
PASSES = 5


def _centre_table(spark, centres: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([(c, j, [float(x) for x in v]) for (c, j), v in sorted(centres.items())], schema)


def seeded_centres(rows: DataFrame, k: int, *, cls: str = "pred", vec: str = "embedding", id_col: str = "id", seed: int = 0,
                   passes: int = PASSES, over: int = OVERSAMPLING) -> dict[tuple, list[float]]:
    """k-means|| for all classes at once: (class, cluster) -> vector, ``k`` or as many as a
    class has distinct vectors among its draws.

    One row of each class starts (the least seeded hash). In a pass every row is drawn
    with probability ``over * k * d2 / sum of d2`` of its class, by a seeded hash of its
    id, so about ``over * k`` of a class; after a few passes the rows are counted by
    their nearest draw, and the weighted draws, classes x (1 + passes x over x k) vectors
    at most in expectation, are cut to ``k`` on the driver: each time the one with the
    largest weight times squared distance to those taken. Passes are aggregates over the
    rows; no task holds a class."""
    kind = dict(rows.dtypes)[cls]
    schema = f"{cls} {kind}, cluster int, centroid array<double>"
    first = rows.groupBy(cls).agg(F.min_by(as_double(vec), F.struct(hash_unit(id_col, seed), F.col(id_col))).alias("v")).collect()   # a row for each class
    centres = {(r[cls], 0): list(r["v"]) for r in first}
    if not centres:
        return {}
    taken = {r[cls]: 1 for r in first}
    for p in range(1, passes + 1):
        near = distance_to_centres(rows, _centre_table(rows.sparkSession, centres, schema), cls=cls, vec=vec)
        total = near.groupBy(cls).agg(F.sum("d2").alias("phi"))
        drawn = (near.join(F.broadcast(total), cls)            # one number for each class
                 .filter((F.col("d2") > 0) & (hash_unit(id_col, seed + p) * F.col("phi") < F.lit(float(over * k)) * F.col("d2")))
                 .select(cls, as_double(vec).alias("v"), id_col).orderBy(cls, id_col).collect())
        for r in drawn:
            centres[r[cls], taken[r[cls]]] = list(r["v"])
            taken[r[cls]] += 1
        if not drawn:
            break
    counts = {(r[cls], r["cluster"]): r["n"] for r in nearest_centre(rows, _centre_table(rows.sparkSession, centres, schema), cls=cls, vec=vec)
              .groupBy(cls, "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for c in taken:
        m = np.array([centres[c, j] for j in range(taken[c])])
        w = np.array([float(counts.get((c, j), 0)) for j in range(taken[c])])
        d2, at = np.full(len(m), np.inf), int(np.argmax(w))
        for j in range(k):
            out[c, j] = m[at].tolist()
            d2 = np.minimum(d2, ((m - m[at]) ** 2).sum(axis=1))
            gain = np.maximum(w, 1e-9) * d2
            at = int(np.argmax(gain))
            if gain[at] <= 0:
                break
    return out


def kmeans_clusters(rows: DataFrame, k: int, *, cls: str = "pred", vec: str = "embedding", id_col: str = "id",
                    seed: int = 0, max_iter: int = 20, tol: float = 1e-4, start: DataFrame | None = None) -> DataFrame:
    """Cluster id per row, K-means inside each class, all classes in one loop.

    Every iteration is one aggregate keyed by (class, cluster) over the rows,
    which are written once. Centres are classes x k vectors. They start from
    k-means|| (``seeded_centres``); ``start`` (cls, cluster,
    centroid) fixes them. A class with fewer distinct vectors has fewer clusters,
    a centre that loses all rows is gone, no rows give no clusters."""
    rows = stored(rows, "kmeans-rows")
    schema = f"{cls} {dict(rows.dtypes)[cls]}, cluster int, centroid array<double>"
    if start is None:
        centres = seeded_centres(rows, k, cls=cls, vec=vec, id_col=id_col, seed=seed)
    else:
        centres = {(r[cls], r["cluster"]): list(r["centroid"]) for r in start.collect()}      # classes x k vectors
    spark = rows.sparkSession
    for _ in range(max_iter):
        moved = nearest_centre(rows, _centre_table(spark, centres, schema), cls=cls, vec=vec)
        new = {(r[cls], r["cluster"]): list(r["centroid"]) for r in cluster_means(moved, cls=cls, vec=vec).collect()}
        shift = max((sum((a - b) ** 2 for a, b in zip(v, centres[key], strict=True)) for key, v in new.items()), default=0.0)
        same = new.keys() == centres.keys()
        centres = new
        if same and shift <= tol * tol:
            break
    return nearest_centre(rows, _centre_table(spark, centres, schema), cls=cls, vec=vec)


def inertia(assigned: DataFrame, *, cls: str = "pred", vec: str = "embedding") -> DataFrame:
    """(class, inertia): squared distances of the rows to the mean of their cluster."""
    return (distance_to_centres(assigned.drop("cluster"), cluster_means(assigned, cls=cls, vec=vec), cls=cls, vec=vec)
            .groupBy(cls).agg(F.sum("d2").alias("inertia")))


def distance_to_centres(rows: DataFrame, centres: DataFrame, *, cls: str = "pred", vec: str = "embedding") -> DataFrame:
    """``rows`` with ``d2``: the squared distance to the nearest centre of the row's class."""
    per_class = centres.groupBy(cls).agg(F.collect_list("centroid").alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: l2_distance(as_double(vec), c)))
    return rows.join(F.broadcast(per_class), cls).withColumn("d2", best * best).drop("_c")


def nearest_centre(rows: DataFrame, centres: DataFrame, *, cls: str = "pred", vec: str = "embedding") -> DataFrame:
    """``rows`` with ``cluster``: the nearest centre (L2) of the row's class, ties to the lower cluster id."""
    per_class = centres.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(l2_distance(as_double(vec), c["centroid"]).alias("d"),
                                                            c["cluster"].alias("k"))))["k"]
    return rows.drop("cluster").join(F.broadcast(per_class), cls).withColumn("cluster", best.cast("int")).drop("_c")


def fixed_clusters(rows: DataFrame, k: int, *, cls: str = "pred", id_col: str = "id", **_) -> DataFrame:
    """Deterministic stand-in clusterer for value checks: ``id mod k'`` with
    ``k' = min(k, rows in the class)``."""
    n = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    return (rows.join(F.broadcast(n), cls)
            .withColumn("cluster", F.pmod(F.col(id_col), F.least(F.lit(k), F.col("_n"))).cast("int"))
            .drop("_n"))


def cluster_means(assigned: DataFrame, *, cls: str = "pred", vec: str = "embedding") -> DataFrame:
    """A10: mean vector per (class, cluster)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return (assigned.groupBy(cls, "cluster")
            .agg(Summarizer.mean(array_to_vector(as_double(vec))).alias("_m"))
            .select(cls, "cluster", vector_to_array("_m").alias("centroid")))


def medoids(assigned: DataFrame, *, cls: str = "pred", vec: str = "embedding",
            id_col: str = "id") -> DataFrame:
    """Per (class, cluster) the member nearest to the mean (L2), ties by id."""
    means = cluster_means(assigned, cls=cls, vec=vec)
    # one row per (class, cluster): bounded by classes x k, so it is broadcast
    d = assigned.join(F.broadcast(means), [cls, "cluster"]) \
                .withColumn("dist", l2_distance(as_double(vec), F.col("centroid")))
    return d.groupBy(cls, "cluster").agg(
        F.min_by(F.col(id_col), F.struct("dist", id_col)).alias("demo_id"),
        F.min("dist").alias("dist"))


def lloyd_step(assigned: DataFrame, *, cls: str = "pred", vec: str = "embedding",
               id_col: str = "id") -> DataFrame:
    """One Lloyd iteration: reassign every row to the nearest mean of its
    class (ties to the lower cluster id), then recompute the means."""
    means = cluster_means(assigned, cls=cls, vec=vec)
    return nearest_centre(assigned, means, cls=cls, vec=vec).select(id_col, cls, vec, "cluster")


def representatives(trusted: DataFrame, k: int, clusterer: Clusterer = kmeans_clusters, *,
                    cls: str = "pred", vec: str = "embedding", id_col: str = "id") -> DataFrame:
    """(class, cluster, demo_id) for the trusted rows of every class."""
    assigned = clusterer(trusted.select(id_col, cls, vec), k, cls=cls)
    return medoids(assigned, cls=cls, vec=vec, id_col=id_col)


def demo_lists(rows: DataFrame, reps: DataFrame, shots_per_class: int, *, cls: str = "pred",
               vec: str = "embedding", id_col: str = "id") -> DataFrame:
    """J2 + W3 + J9 + A12: for every row, the ``shots_per_class`` most similar
    representatives of each class, lists concatenated in class order
    -> ``(id, demo_ids, sims)``. Representatives are at most classes x k rows,
    so they are broadcast (size checked inside ``knn_topk``)."""
    pool = reps.join(rows.select(F.col(id_col).alias("demo_id"), vec), "demo_id") \
               .select("demo_id", F.col(cls).alias("demo_class"), vec)
    wide = knn_topk(rows.select(id_col, vec), pool, shots_per_class, query_id=id_col, query_vec=vec,
                    pool_id="demo_id", pool_vec=vec, pool_group="demo_class", pool_label="demo_class",
                    wide=True)
    return wide.select(id_col, "demo_ids", "sims")
