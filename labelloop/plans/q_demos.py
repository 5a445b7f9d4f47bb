"""Catalogue: demonstration pool construction and feedback (L4, L5, A9-A12,
J2-J4, J9, W3, S9, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.operators.demos import (cluster_means, demo_lists, fixed_clusters, kmeans_clusters,
                                       lloyd_step, medoids, representatives)
from labelloop.operators.retrieve import fetch_demos
from labelloop.operators.select import top_fraction
from labelloop.plans import fixtures as fx
from labelloop.plans.q_selection import SQL_TOP
from labelloop.plans.registry import register
from labelloop.plans.rounds import Feedback, emit_feedback, read_feedback, write_feedback
from labelloop.session import scratch_dir, stored

K = 100 // fx.NUM_CLASSES          # clusters per class (select_demo_num // C)
SHOTS_PER_CLASS = fx.SHOTS // fx.NUM_CLASSES

SQL_ASSIGN = SQL_TOP + """,
tc AS (SELECT t.id, t.pred, f.v FROM top t JOIN fx_scored f ON f.id = t.id),
tn AS (SELECT pred, count(*) AS n FROM tc GROUP BY pred),
asg AS (SELECT tc.id, tc.pred, tc.v, CAST(tc.id % least(10, tn.n) AS INTEGER) AS cluster
        FROM tc JOIN tn ON tn.pred = tc.pred),
al AS (SELECT id, pred, cluster, UNNEST(range(0, len(v))) AS pos, UNNEST(v) AS x FROM asg),
cm AS (SELECT pred, cluster, pos, avg(x) AS m FROM al GROUP BY pred, cluster, pos),
md AS (SELECT al.id, al.pred, al.cluster, sqrt(sum((al.x - cm.m) * (al.x - cm.m))) AS dist
       FROM al JOIN cm ON cm.pred = al.pred AND cm.cluster = al.cluster AND cm.pos = al.pos
       GROUP BY al.id, al.pred, al.cluster),
reps AS (SELECT pred, cluster, id AS demo_id, dist FROM
           (SELECT *, row_number() OVER (PARTITION BY pred, cluster ORDER BY dist, id) AS rn FROM md) WHERE rn = 1)"""

SQL_LISTS = SQL_ASSIGN + """,
rv AS (SELECT reps.demo_id, reps.pred AS demo_class, f.v FROM reps JOIN fx_scored f ON f.id = reps.demo_id),
cs AS (SELECT f.id, rv.demo_class, rv.demo_id, list_cosine_similarity(f.v, rv.v) AS sim FROM fx_scored f, rv),
ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, demo_class ORDER BY sim DESC, demo_id) AS rk
                      FROM cs) WHERE rk <= 1),
dl AS (SELECT id, demo_class, demo_id, sim, row_number() OVER (PARTITION BY id ORDER BY demo_class, rk) - 1 AS pos
       FROM ck)"""


def _scored(spark, sf_dir):
    return fx.scored(spark, sf_dir)


def _trusted_rows(spark, sf_dir):
    s = _scored(spark, sf_dir)
    top = top_fraction(s)
    return s.join(top.select("id"), "id").select("id", "pred", "embedding")


@register("q_kmeans_class")
def q_kmeans_class(spark, sf_dir):
    """K-means inside each predicted class over the trusted rows from k-means|| starts
    (seed 0, k capped by distinct vectors). Random seeding: rows-only check."""
    a = kmeans_clusters(_trusted_rows(spark, sf_dir), K, cls="pred")
    return a.select("id", "pred", "cluster")


def sql_lloyd(k: int, means: str) -> str:
    """mv{k}: rows at their nearest mean of ``means`` (pred, cluster, pos, m); mn{k}: the means of that."""
    return f"""
nr{k} AS (SELECT al.id, al.pred, cm.cluster, sqrt(sum((al.x - cm.m) * (al.x - cm.m))) AS d
          FROM al JOIN {means} cm ON cm.pred = al.pred AND cm.pos = al.pos GROUP BY al.id, al.pred, cm.cluster),
mv{k} AS (SELECT id, pred, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS rn FROM nr{k}) WHERE rn = 1),
mn{k} AS (SELECT al.pred, mv{k}.cluster, al.pos, avg(al.x) AS m FROM al JOIN mv{k} ON mv{k}.id = al.id GROUP BY al.pred, mv{k}.cluster, al.pos)"""


@register("q_kmeans_fixed", SQL_ASSIGN + "," + sql_lloyd(1, "cm") + "," + sql_lloyd(2, "mn1") + "," + sql_lloyd(3, "mn2") + """
SELECT id, pred, CAST(cluster AS INTEGER) AS cluster FROM mv3""")
def q_kmeans_fixed(spark, sf_dir):
    """A9 by value: the whole K-means loop from fixed centres (the means of the fixed
    assignment), two iterations and the last assignment."""
    rows = stored(_trusted_rows(spark, sf_dir), "trusted")
    start = cluster_means(fixed_clusters(rows, K, cls="pred"))
    return kmeans_clusters(rows, K, cls="pred", start=start, max_iter=2, tol=0.0).select("id", "pred", "cluster")


@register("q_lloyd_step", SQL_ASSIGN + """,
near AS (SELECT al.id, al.pred, cm.cluster, sqrt(sum((al.x - cm.m) * (al.x - cm.m))) AS d
         FROM al JOIN cm ON cm.pred = al.pred AND cm.pos = al.pos GROUP BY al.id, al.pred, cm.cluster),
moved AS (SELECT id, pred, cluster FROM
            (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS rn FROM near) WHERE rn = 1)
SELECT id, pred, cluster FROM moved""")
def q_lloyd_step(spark, sf_dir):
    """One Lloyd step from the fixed assignment: every trusted row moves to
    the nearest cluster mean of its class."""
    a = fixed_clusters(_trusted_rows(spark, sf_dir), K, cls="pred")
    return lloyd_step(a, cls="pred").select("id", "pred", "cluster")


@register("q_centroid", SQL_ASSIGN + """
SELECT pred, cluster, CAST(count(*) AS BIGINT) AS dims, round(sum(m), 6) AS centroid_sum, round(sqrt(sum(m * m)), 6) AS centroid_norm
FROM cm GROUP BY pred, cluster""")
def q_centroid(spark, sf_dir):
    """A10: mean vector per (class, cluster), summarised by sum and norm."""
    a = fixed_clusters(_trusted_rows(spark, sf_dir), K, cls="pred")
    m = cluster_means(a, cls="pred")
    return m.select("pred", "cluster", F.size("centroid").cast("bigint").alias("dims"),
                    F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("centroid_sum"),
                    F.round(F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x)), 6)
                    .alias("centroid_norm"))


@register("q_medoid", SQL_ASSIGN + """
SELECT pred, cluster, demo_id, round(dist, 6) AS dist FROM reps""")
def q_medoid(spark, sf_dir):
    """Member nearest to its cluster mean."""
    a = fixed_clusters(_trusted_rows(spark, sf_dir), K, cls="pred")
    return medoids(a, cls="pred").select("pred", "cluster", "demo_id", F.round("dist", 6).alias("dist"))


def _lists(spark, sf_dir, clusterer=fixed_clusters):
    s = _scored(spark, sf_dir)
    reps = representatives(_trusted_rows(spark, sf_dir), K, clusterer, cls="pred")
    return demo_lists(s.select("id", "pred", "embedding"), reps, SHOTS_PER_CLASS)


@register("q_class_knn", SQL_LISTS + """
SELECT id, demo_class, demo_id, round(sim, 6) AS sim FROM ck""")
def q_class_knn(spark, sf_dir):
    """J2 + W3: per row and class, the most similar class representative."""
    s = _scored(spark, sf_dir)
    reps = representatives(_trusted_rows(spark, sf_dir), K, fixed_clusters, cls="pred")
    pool = reps.join(s.select(F.col("id").alias("demo_id"), "embedding"), "demo_id") \
               .select("demo_id", F.col("pred").alias("demo_class"), "embedding")
    from labelloop.operators.retrieve import knn_topk
    long = knn_topk(s.select("id", "embedding"), pool, SHOTS_PER_CLASS, pool_group="demo_class")
    return long.select("id", F.col("demo_class").cast("int").alias("demo_class"), "demo_id",
                       F.round("sim", 6).alias("sim"))


@register("q_demo_lists", SQL_LISTS + """
SELECT id, CAST(pos AS BIGINT) AS pos, demo_id FROM dl""")
def q_demo_lists(spark, sf_dir):
    """A12 + J9: per-row demo id lists, classes concatenated in class order."""
    lists = _lists(spark, sf_dir)
    return lists.select("id", F.posexplode("demo_ids").alias("pos", "demo_id")) \
                .select("id", F.col("pos").cast("bigint").alias("pos"), "demo_id")


@register("q_demo_selection", SQL_LISTS + """
SELECT id, CAST(count(*) AS BIGINT) AS n_demos, CAST(sum(demo_id) AS BIGINT) AS demo_id_sum FROM dl GROUP BY id""")
def q_demo_selection(spark, sf_dir):
    """L4 end to end (fixed clusterer): trusted rows -> clusters -> medoids ->
    per-class retrieval -> lists; summarised per row."""
    lists = _lists(spark, sf_dir)
    return lists.select("id", F.size("demo_ids").cast("bigint").alias("n_demos"),
                        F.aggregate("demo_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("demo_id_sum"))


@register("q_demo_selection_kmeans")
def q_demo_selection_kmeans(spark, sf_dir):
    """L4 with MLlib K-means (the production clusterer): rows-only check."""
    lists = _lists(spark, sf_dir, clusterer=kmeans_clusters)
    return lists.select("id", F.size("demo_ids").cast("bigint").alias("n_demos"))


@register("q_remap_ids", SQL_LISTS + """
SELECT dl.id, CAST(dl.pos AS BIGINT) AS pos, dl.demo_id, r.pred AS demo_class, CAST(r.cluster AS INTEGER) AS cluster
FROM dl JOIN reps r ON r.demo_id = dl.demo_id""")
def q_remap_ids(spark, sf_dir):
    """List positions mapped back to dataset ids and their pool entry."""
    s = _scored(spark, sf_dir)
    reps = representatives(_trusted_rows(spark, sf_dir), K, fixed_clusters, cls="pred")
    lists = demo_lists(s.select("id", "pred", "embedding"), reps, SHOTS_PER_CLASS)
    long = lists.select("id", F.posexplode("demo_ids").alias("pos", "demo_id"))
    return long.join(F.broadcast(reps.select("demo_id", F.col("pred").alias("demo_class"), "cluster")), "demo_id") \
               .select("id", F.col("pos").cast("bigint").alias("pos"), "demo_id", "demo_class", "cluster")


@register("q_fetch_demos", SQL_LISTS + """
SELECT dl.id, CAST(dl.pos AS BIGINT) AS pos, dl.demo_id, d.n_chars FROM dl LEFT JOIN documents d ON d.doc_id = dl.demo_id""")
def q_fetch_demos(spark, sf_dir):
    """Demo rows fetched by the ordered id lists (text length shown)."""
    lists = _lists(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    f = fetch_demos(lists, docs, cols=("n_chars",))
    return f.select("id", F.col("pos").cast("bigint").alias("pos"), "demo_id", "n_chars")


@register("q_demo_labels", SQL_LISTS + """
SELECT dl.id, CAST(dl.pos AS BIGINT) AS pos, dl.demo_id, f.pred AS demo_label FROM dl JOIN fx_scored f ON f.id = dl.demo_id""")
def q_demo_labels(spark, sf_dir):
    """Pseudo-label of every listed demo."""
    s = _scored(spark, sf_dir)
    lists = _lists(spark, sf_dir)
    f = fetch_demos(lists, s.select("id", F.col("pred").alias("demo_label")), cols=("demo_label",))
    return f.select("id", F.col("pos").cast("bigint").alias("pos"), "demo_id", "demo_label")


def _feedback_roundtrip(spark, sf_dir):
    fb = emit_feedback(_scored(spark, sf_dir), fx.NUM_CLASSES, clusterer=fixed_clusters)
    root = scratch_dir(spark, "feedback")
    write_feedback(fb, root, 1)
    # a second round must leave the first alone
    write_feedback(Feedback(*(t.limit(0) for t in (fb.trusted, fb.demos, fb.pseudo))), root, 2)
    if not read_feedback(spark, root, 2).pseudo.isEmpty():
        raise ValueError("round 2 is empty")
    return read_feedback(spark, root, 1)


@register("q_feedback_sink", SQL_LISTS + """
SELECT 'trusted' AS tbl, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS s FROM top
UNION ALL SELECT 'demos', CAST(count(DISTINCT id) AS BIGINT), CAST(sum(demo_id) AS BIGINT) FROM dl
UNION ALL SELECT 'pseudo', CAST(count(*) AS BIGINT), CAST(sum(pred) AS BIGINT) FROM fx_scored""")
def q_feedback_sink(spark, sf_dir):
    """The three feedback tables written per round (counts and sums read back)."""
    fb = _feedback_roundtrip(spark, sf_dir)
    t = fb.trusted.agg(F.lit("trusted").alias("tbl"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    d = fb.demos.agg(F.lit("demos").alias("tbl"), F.count(F.lit(1)).alias("n"),
                     F.sum(F.aggregate("demo_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("s"))
    p = fb.pseudo.agg(F.lit("pseudo").alias("tbl"), F.count(F.lit(1)).alias("n"),
                      F.sum("pred").cast("bigint").alias("s"))
    return t.unionByName(d).unionByName(p)


@register("q_feedback_scan", SQL_LISTS + """
SELECT f.id, f.pred, t.id IS NOT NULL AS trusted FROM fx_scored f LEFT JOIN top t ON t.id = f.id""")
def q_feedback_scan(spark, sf_dir):
    """Feedback read back: pseudo-label and trusted flag of every row."""
    fb = _feedback_roundtrip(spark, sf_dir)
    t = fb.trusted.select("id", F.lit(True).alias("trusted"))
    return fb.pseudo.join(t, "id", "left").select("id", "pred", F.coalesce("trusted", F.lit(False)).alias("trusted"))

