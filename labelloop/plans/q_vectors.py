"""Catalogue: scorer output and vector / logit functions (X4, A2-A5, F1-F8,
F10, F12, P5, P6, P13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.functions import vectors as V
from labelloop.operators.score import mean_loss, scaled_loss
from labelloop.plans import fixtures as fx
from labelloop.plans.registry import register

W = "WITH " + fx.SQL_SCORED


def _exploded(df, arr, name, digits=6):
    return df.select("id", F.posexplode(arr).alias("pos", name)) \
             .select("id", F.col("pos").cast("bigint").alias("pos"), F.round(name, digits).alias(name))


def _duck_exploded(arr_sql, name, src="fx_scored", where="", digits=6):
    return (f"SELECT id, CAST(pos AS BIGINT) AS pos, round({name}, {digits}) AS {name} FROM "
            f"(SELECT id, UNNEST(range(0, len({arr_sql}))) AS pos, UNNEST({arr_sql}) AS {name} FROM {src} {where})")


@register("q_score", W + """
SELECT id, pred, round(conf, 6) AS conf, round(loss, 4) AS loss FROM fx_scored""")
def q_score(spark, sf_dir):
    """Centroid-head scores -> prediction, confidence, per-row loss."""
    s = fx.scored(spark, sf_dir)
    return s.select("id", "pred", F.round("conf", 6).alias("conf"), F.round("loss", 4).alias("loss"))


@register("q_argmax", W + """
SELECT id, pred, round(conf, 6) AS conf FROM fx_scored""")
def q_argmax(spark, sf_dir):
    """A4: row max and first argmax of the logits."""
    s = fx.scored(spark, sf_dir)
    return s.select("id", V.argmax("logits").alias("pred"), F.round(V.row_max("logits"), 6).alias("conf"))


@register("q_row_ce", W + """
SELECT id, round(loss, 4) AS loss FROM fx_scored WHERE anno >= 0""")
def q_row_ce(spark, sf_dir):
    """per-row cross-entropy against the (valid) annotation."""
    s = fx.scored(spark, sf_dir)
    return s.filter("anno >= 0").select("id", F.round(V.cross_entropy("logits", "anno"), 4).alias("loss"))


@register("q_softmax", W + """,
sm AS (SELECT id, list_transform(logits, lambda z: exp(z - list_max(logits))) AS ex FROM fx_scored),
p AS (SELECT id, list_transform(ex, lambda t: t / list_sum(ex)) AS p FROM sm)
""" + _duck_exploded("p", "p", src="p"))
def q_softmax(spark, sf_dir):
    """class probabilities, exploded (id, pos, p)."""
    return _exploded(fx.scored(spark, sf_dir), V.softmax("logits"), "p")


@register("q_log_softmax", W + """,
ls AS (SELECT id, list_transform(logits, lambda z: z - (list_max(logits)
          + ln(list_sum(list_transform(logits, lambda t: exp(t - list_max(logits))))))) AS lp FROM fx_scored)
""" + _duck_exploded("lp", "lp", src="ls"))
def q_log_softmax(spark, sf_dir):
    """log-probabilities, exploded."""
    return _exploded(fx.scored(spark, sf_dir), V.log_softmax("logits"), "lp")


@register("q_temperature", W + """,
t AS (SELECT id, list_transform(logits, lambda z: z / 0.85) AS zt FROM fx_scored)
""" + _duck_exploded("zt", "zt", src="t"))
def q_temperature(spark, sf_dir):
    """logits divided by the temperature 0.85."""
    return _exploded(fx.scored(spark, sf_dir), V.scale("logits", 0.85), "zt")


@register("q_one_hot", W + """,
o AS (SELECT id, list_transform(range(0, 10), lambda i: CASE WHEN i = anno THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS oh
      FROM fx_scored WHERE anno >= 0)
""" + _duck_exploded("oh", "oh", src="o"))
def q_one_hot(spark, sf_dir):
    """one-hot targets of the valid annotations."""
    s = fx.scored(spark, sf_dir).filter("anno >= 0")
    return _exploded(s, V.one_hot("anno", fx.NUM_CLASSES), "oh")


SQL_V2 = """,
v2 AS (SELECT id, v, list_transform(range(1, len(v) + 1), lambda i: 0.9 * v[i] + 0.1 * v[len(v) + 1 - i]) AS w
       FROM fx_anno)"""


@register("q_cosine", "WITH " + fx.SQL_ANNO + SQL_V2 + """
SELECT id, round(list_cosine_similarity(v, w), 6) AS cos FROM v2""")
def q_cosine(spark, sf_dir):
    """cosine similarity between a vector and its second view."""
    a = fx.noisy_annotation(spark, sf_dir)
    return a.select("id", F.round(V.cosine("embedding", fx.view2()), 6).alias("cos"))


@register("q_l2", "WITH " + fx.SQL_ANNO + SQL_V2 + """
SELECT id, round(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i])))), 6) AS l2
FROM v2""")
def q_l2(spark, sf_dir):
    """Euclidean distance between a vector and its second view."""
    a = fx.noisy_annotation(spark, sf_dir)
    return a.select("id", F.round(V.l2_distance("embedding", fx.view2()), 6).alias("l2"))


@register("q_vector_lerp", "WITH " + fx.SQL_ANNO + SQL_V2 + """,
lp AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: 0.7 * v[i] + 0.3 * w[i]) AS mix FROM v2)
""" + _duck_exploded("mix", "mix", src="lp"))
def q_vector_lerp(spark, sf_dir):
    """F8: interpolation 0.7 a + 0.3 b of a vector and its second view."""
    a = fx.noisy_annotation(spark, sf_dir)
    return _exploded(a, V.lerp("embedding", fx.view2(), 0.7), "mix")


@register("q_cls_vector", "WITH " + fx.SQL_ANNO + SQL_V2 + """,
seqs AS (SELECT id, [w, v] AS hs FROM v2)
""" + _duck_exploded("hs[1]", "x", src="seqs"))
def q_cls_vector(spark, sf_dir):
    """First position vector of a (2-position) hidden-state sequence."""
    a = fx.noisy_annotation(spark, sf_dir).select("id", F.array(fx.view2(), F.col("embedding")).alias("hs"))
    return _exploded(a, V.first_position("hs"), "x")


@register("q_row_kl", W + """,
l2 AS (SELECT f.id, f.logits AS z1, list(lg.z2 ORDER BY lg.cls) AS z2 FROM fx_scored f JOIN
         (SELECT l.id, c.cls, sum((0.9 * a.v[l.pos + 1] + 0.1 * a.v[len(a.v) - l.pos]) * c.m) AS z2
          FROM fx_long l JOIN fx_anno a ON a.id = l.id JOIN fx_centroid c ON l.pos = c.pos GROUP BY l.id, c.cls) lg
         ON lg.id = f.id GROUP BY f.id, f.logits),
pr AS (SELECT id,
         list_transform(z2, lambda t: exp(t - list_max(z2)) / list_sum(list_transform(z2, lambda u: exp(u - list_max(z2))))) AS p,
         list_transform(z1, lambda t: t / 0.85 - (list_max(z1) / 0.85
             + ln(list_sum(list_transform(z1, lambda u: exp(u / 0.85 - list_max(z1) / 0.85)))))) AS lq
       FROM l2)
SELECT id, round(list_sum(list_transform(range(1, len(p) + 1),
         lambda i: CASE WHEN p[i] > 0 THEN p[i] * (ln(p[i]) - lq[i]) ELSE 0.0 END)), 6) AS kl
FROM pr""")
def q_row_kl(spark, sf_dir):
    """KL(teacher || student): teacher = softmax of the second view's
    logits, student = log-softmax of the logits divided by 0.85."""
    from labelloop.operators.score import centroid_head, score
    anno = fx.noisy_annotation(spark, sf_dir)
    head = centroid_head(anno, fx.NUM_CLASSES, label_col="anno")
    s = score(score(anno.withColumn("v2", fx.view2()), head), head, vec_col="v2", out_col="logits2")
    kl = V.kl_div(V.softmax("logits2"), V.log_softmax(V.scale("logits", 0.85)))
    return s.select("id", F.round(kl, 6).alias("kl"))


@register("q_loss_minmax", W + """
SELECT round(min(loss), 6) AS lo, round(max(loss), 6) AS hi FROM fx_scored WHERE valid""")
def q_loss_minmax(spark, sf_dir):
    """A2: min and max loss over valid rows."""
    s = fx.scored(spark, sf_dir)
    return s.filter("valid").agg(F.round(F.min("loss"), 6).alias("lo"), F.round(F.max("loss"), 6).alias("hi"))


@register("q_minmax_scale", W + """,
r AS (SELECT min(loss) AS lo, max(loss) AS hi FROM fx_scored WHERE valid)
SELECT id, round(coalesce((loss - lo) / nullif(hi - lo, 0), 0), 6) AS x FROM fx_scored, r WHERE valid""")
def q_minmax_scale(spark, sf_dir):
    """min-max scaled loss of the valid rows."""
    return scaled_loss(fx.scored(spark, sf_dir)).filter("valid").select("id", F.round("x", 6).alias("x"))


@register("q_mean_ce", W + """
SELECT round(avg(loss), 6) AS mean_loss FROM fx_scored WHERE matched""")
def q_mean_ce(spark, sf_dir):
    """A5: mean cross-entropy over a subset (the matched rows)."""
    return mean_loss(fx.scored(spark, sf_dir), where=F.col("matched")) \
        .select(F.round("mean_loss", 6).alias("mean_loss"))


@register("q_class_counts", W + """
SELECT pred, count(*) AS n, CAST(sum(CASE WHEN matched THEN 1 ELSE 0 END) AS BIGINT) AS n_matched
FROM fx_scored GROUP BY pred""")
def q_class_counts(spark, sf_dir):
    """A3: rows and matched rows per predicted class."""
    s = fx.scored(spark, sf_dir)
    return s.groupBy("pred").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.col("matched").cast("bigint")).alias("n_matched"))


@register("q_valid_rows", W + """
SELECT id, anno FROM fx_scored WHERE anno >= 0""")
def q_valid_rows(spark, sf_dir):
    """P5: rows whose annotation is a class (not the -1 sentinel)."""
    return fx.scored(spark, sf_dir).filter(F.col("anno") >= 0).select("id", "anno")


@register("q_matched", W + """
SELECT id, matched FROM fx_scored""")
def q_matched(spark, sf_dir):
    """Prediction equals the valid annotation."""
    return fx.scored(spark, sf_dir).select("id", "matched")
