"""Catalogue: demonstration pool, kNN retrieval and the similarity vote."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.operators.annotate import knn_vote
from labelloop.operators.metrics import accuracy
from labelloop.operators.pruned import pruned_topk
from labelloop.operators.retrieve import knn_topk
from labelloop.plans import fixtures as fx
from labelloop.plans.registry import register


def knn_wide(spark, sf_dir, k=fx.SHOTS):
    pool = fx.demo_pool(spark, sf_dir)
    return knn_topk(fx.vectors(spark, sf_dir), pool, k, pool_label="anno", wide=True)


@register("q_demo_pool", "WITH " + fx.SQL_POOL + """
SELECT demo_id, anno FROM pool""")
def q_demo_pool(spark, sf_dir):
    """Demonstration pool (10 per class, nearest to the class mean)."""
    return fx.demo_pool(spark, sf_dir).select("demo_id", F.col("anno").cast("int").alias("anno"))


@register("q_knn_demos", "WITH " + fx.SQL_KNN + """
SELECT id, CAST(rank AS BIGINT) AS rank, demo_id, CAST(anno AS BIGINT) AS anno, round(sim, 6) AS sim FROM knn""")
def q_knn_demos(spark, sf_dir):
    """J1 + W1: top-10 demonstrations per corpus row by cosine similarity."""
    pool = fx.demo_pool(spark, sf_dir)
    long = knn_topk(fx.vectors(spark, sf_dir), pool, fx.SHOTS, pool_label="anno")
    return long.select("id", F.col("rank").cast("bigint").alias("rank"), "demo_id",
                       F.col("demo_label").alias("anno"), F.round("sim", 6).alias("sim"))


@register("q_knn_pruned", "WITH " + fx.SQL_VECTORS + f""",
sims AS (SELECT a.id, b.id AS demo_id, b.label, list_cosine_similarity(a.v, b.v) AS sim FROM e a, e b WHERE a.id <> b.id),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, demo_id) AS rank FROM sims WHERE NOT isnan(sim))
SELECT id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM knn WHERE rank <= {fx.SHOTS}""")
def q_knn_pruned(spark, sf_dir):
    """J1 + W1 over a large pool: the nearest of all other vectors for every vector, by clusters
    that are ruled out by a bound on the cosine (exact)."""
    v = fx.vectors(spark, sf_dir)
    pool = v.select(F.col("id").alias("demo_id"), F.col("label").alias("anno"), "embedding")
    found = pruned_topk(v, pool, fx.SHOTS, pool_label="anno", exclude_self=True)
    return found.rows.select("id", "rank", F.round("sim", 6).alias("sim"))


SQL_VOTE = "WITH " + fx.SQL_KNN + """,
votes AS (SELECT id, anno, sum(sim) AS score FROM knn GROUP BY id, anno),
vote AS (SELECT id, anno AS pred FROM
           (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, anno) AS rn FROM votes)
         WHERE rn = 1)"""


@register("q_knn_vote", SQL_VOTE + """
SELECT vote.id, CAST(vote.pred AS INTEGER) AS pred, e.label AS gold FROM vote JOIN e ON e.id = vote.id""")
def q_knn_vote(spark, sf_dir):
    """Similarity-weighted vote of the retrieved demonstrations."""
    votes = knn_vote(knn_wide(spark, sf_dir))
    return votes.join(fx.vectors(spark, sf_dir).select("id", F.col("label").alias("gold")), "id")


@register("q_accuracy", SQL_VOTE + """
SELECT round(avg(CASE WHEN v.pred = e.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM vote v JOIN e ON e.id = v.id""")
def q_accuracy(spark, sf_dir):
    """A1: accuracy of the vote against the gold label."""
    votes = knn_vote(knn_wide(spark, sf_dir)).join(fx.vectors(spark, sf_dir).select("id", "label"), "id")
    return accuracy(votes).select(F.round("accuracy", 6).alias("accuracy"), "n")
