"""Catalogue: sample selection (L3) - mixture fit and clean set, per-class top
fraction, trusted set, warm-up gate, clean split and the id set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.operators.score import scaled_loss
from labelloop.operators.select import clean_set, fit_gmm, split_clean, top_fraction, warmup_gate
from labelloop.plans import fixtures as fx
from labelloop.plans.registry import register

# DuckDB: scaled loss, 2-means from (min, max), then EM, both as recursive CTEs
SQL_GMM = "WITH RECURSIVE " + fx.SQL_SCORED + """,
rng AS (SELECT min(loss) AS lo, max(loss) AS hi FROM fx_scored WHERE valid),
xs AS (SELECT id, coalesce((loss - lo) / nullif(hi - lo, 0), 0) AS x FROM fx_scored, rng WHERE valid),
km(it, c0, c1, done) AS (
  SELECT 0, (SELECT min(x) FROM xs), (SELECT max(x) FROM xs), false
  UNION ALL
  SELECT it + 1, n0, n1, n0 = c0 AND n1 = c1 FROM (
    SELECT km.it, km.c0, km.c1,
           coalesce(avg(CASE WHEN abs(x - km.c0) <= abs(x - km.c1) THEN x END), km.c0) AS n0,
           coalesce(avg(CASE WHEN abs(x - km.c0) > abs(x - km.c1) THEN x END), km.c1) AS n1
    FROM km, xs WHERE NOT km.done AND km.it < 20 GROUP BY km.it, km.c0, km.c1)),
kmf AS (SELECT c0, c1 FROM km ORDER BY it DESC LIMIT 1),
hard AS (SELECT x, CASE WHEN abs(x - c0) <= abs(x - c1) THEN 1.0 ELSE 0.0 END AS h0,
                   CASE WHEN abs(x - c0) <= abs(x - c1) THEN 0.0 ELSE 1.0 END AS h1 FROM xs, kmf),
init AS (SELECT count(*) AS n, sum(h0) + 2.220446049250313e-15 AS n0, sum(h1) + 2.220446049250313e-15 AS n1,
                sum(h0 * x) AS sx0, sum(h1 * x) AS sx1, sum(h0 * x * x) AS sxx0, sum(h1 * x * x) AS sxx1 FROM hard),
em(it, n, w0, w1, m0, m1, v0, v1, lb, done) AS (
  SELECT 0, n, n0 / n, n1 / n, sx0 / n0, sx1 / n1,
         greatest(sxx0 / n0 - (sx0 / n0) * (sx0 / n0), 0) + 0.0005,
         greatest(sxx1 / n1 - (sx1 / n1) * (sx1 / n1), 0) + 0.0005, '-inf'::DOUBLE, false FROM init
  UNION ALL
  SELECT it + 1, n, n0 / n, n1 / n, sx0 / n0, sx1 / n1,
         greatest(sxx0 / n0 - (sx0 / n0) * (sx0 / n0), 0) + 0.0005,
         greatest(sxx1 / n1 - (sx1 / n1) * (sx1 / n1), 0) + 0.0005, lbn, abs(lbn - lb) < 0.01
  FROM (
    SELECT it, n, lb, sum(r0) + 2.220446049250313e-15 AS n0, sum(r1) + 2.220446049250313e-15 AS n1,
           sum(r0 * x) AS sx0, sum(r1 * x) AS sx1, sum(r0 * x * x) AS sxx0, sum(r1 * x * x) AS sxx1,
           avg(lpn) AS lbn
    FROM (
      SELECT it, n, lb, x, exp(a - lpn) AS r0, exp(b - lpn) AS r1, lpn FROM (
        SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lpn FROM (
          SELECT em.it, em.n, em.lb, xs.x,
                 ln(w0) - 0.5 * (ln(2 * pi()) + ln(v0)) - (xs.x - m0) * (xs.x - m0) / (2 * v0) AS a,
                 ln(w1) - 0.5 * (ln(2 * pi()) + ln(v1)) - (xs.x - m1) * (xs.x - m1) / (2 * v1) AS b
          FROM em, xs WHERE NOT em.done AND em.it < 10)))
    GROUP BY it, n, lb)),
fit AS (SELECT * FROM em ORDER BY it DESC LIMIT 1),
post AS (
  SELECT id, CASE WHEN m0 <= m1 THEN exp(a - lpn) ELSE exp(b - lpn) END AS prob FROM (
    SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lpn FROM (
      SELECT xs.id, fit.m0, fit.m1,
             ln(w0) - 0.5 * (ln(2 * pi()) + ln(v0)) - (xs.x - m0) * (xs.x - m0) / (2 * v0) AS a,
             ln(w1) - 0.5 * (ln(2 * pi()) + ln(v1)) - (xs.x - m1) * (xs.x - m1) / (2 * v1) AS b
      FROM xs, fit)))"""


def _selected(spark, sf_dir):
    s = scaled_loss(fx.scored(spark, sf_dir))
    return clean_set(s)


@register("q_gmm_fit", SQL_GMM + """
SELECT CAST(it AS BIGINT) AS n_iter, round(least(m0, m1), 6) AS mean_clean, round(greatest(m0, m1), 6) AS mean_noisy,
       round(CASE WHEN m0 <= m1 THEN v0 ELSE v1 END, 6) AS var_clean,
       round(CASE WHEN m0 <= m1 THEN w0 ELSE w1 END, 6) AS weight_clean FROM fit""")
def q_gmm_fit(spark, sf_dir):
    """Two-component mixture on the scaled loss of the valid rows."""
    mix = fit_gmm(scaled_loss(fx.scored(spark, sf_dir)).filter("valid"), "x")
    c = mix.clean_component
    row = [(mix.n_iter, round(min(mix.means), 6), round(max(mix.means), 6),
            round(mix.variances[c], 6), round(mix.weights[c], 6))]
    return spark.createDataFrame(row, "n_iter bigint, mean_clean double, mean_noisy double, "
                                      "var_clean double, weight_clean double")


@register("q_gmm_posterior", SQL_GMM + """
SELECT id, round(prob, 6) AS prob FROM post""")
def q_gmm_posterior(spark, sf_dir):
    """Posterior of the lower-mean component for every valid row."""
    return _selected(spark, sf_dir).filter("valid").select("id", F.round("prob", 6).alias("prob"))


@register("q_clean_set", SQL_GMM + """
SELECT id FROM post WHERE prob > 0.7""")
def q_clean_set(spark, sf_dir):
    """Rows whose clean posterior exceeds 0.7."""
    return _selected(spark, sf_dir).filter("chosen").select("id")


SQL_TOP = "WITH " + fx.SQL_SCORED + """,
m AS (SELECT id, pred, conf FROM fx_scored WHERE matched),
r AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY conf DESC, id) AS rk,
             count(*) OVER (PARTITION BY pred) AS n FROM m),
top AS (SELECT id, pred FROM r WHERE rk <= floor(n * 0.2))"""


@register("q_top_fraction", SQL_TOP + """
SELECT id, pred FROM top""")
def q_top_fraction(spark, sf_dir):
    """Per predicted class, the 20 % most confident matched rows."""
    return top_fraction(fx.scored(spark, sf_dir)).select("id", "pred")


@register("q_trusted_set", SQL_TOP + """
SELECT id FROM top""")
def q_trusted_set(spark, sf_dir):
    """Trusted set = union over classes of the top fractions."""
    return top_fraction(fx.scored(spark, sf_dir)).select("id")


@register("q_warmup_gate", SQL_GMM + """
SELECT xs.id, true AS chosen_epoch2, coalesce(post.prob > 0.7, false) AS chosen_epoch4
FROM xs LEFT JOIN post ON post.id = xs.id""")
def q_warmup_gate(spark, sf_dir):
    """With warm-up 3, epoch 2 trains on every valid row, epoch 4 on the chosen ones."""
    s = _selected(spark, sf_dir).filter("valid")
    return s.select("id", warmup_gate("chosen", 2, 3).alias("chosen_epoch2"),
                    warmup_gate("chosen", 4, 3).alias("chosen_epoch4"))


@register("q_split_clean", SQL_GMM + """
SELECT f.id, CASE WHEN f.valid AND coalesce(post.prob > 0.7, false) THEN 'clean'
                  WHEN f.valid THEN 'unchosen' END AS part
FROM fx_scored f LEFT JOIN post ON post.id = f.id""")
def q_split_clean(spark, sf_dir):
    """Clean / un-chosen split; invalid rows in neither (NULL)."""
    return split_clean(_selected(spark, sf_dir)).select("id", "part")


@register("q_intersect_ids", "WITH " + fx.SQL_SCORED + """
SELECT id, pred AS cls FROM fx_scored INTERSECT SELECT id, anno FROM fx_scored WHERE valid""")
def q_intersect_ids(spark, sf_dir):
    """For every class, rows predicted as it that are also annotated with it (set intersection)."""
    s = fx.scored(spark, sf_dir)
    return s.select("id", F.col("pred").alias("cls")).intersect(s.filter("valid").select("id", F.col("anno").alias("cls")))


@register("q_except_ids", SQL_GMM + """
SELECT id FROM xs EXCEPT SELECT id FROM post WHERE prob > 0.7""")
def q_except_ids(spark, sf_dir):
    """Valid rows minus chosen rows (anti join)."""
    s = _selected(spark, sf_dir)
    return s.filter("valid").select("id").join(s.filter("chosen").select("id"), "id", "left_anti")
