"""Catalogue: self-training round (L6) - mini-batch buckets, mixup partners and
coefficients, soft-label rows, gradient at zero, loss terms, head fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.functions import vectors as V
from labelloop.operators.objective import Objective, descend, fit, training_table
from labelloop.operators.score import add_scores, centroid_head, head_table, scaled_loss, score
from labelloop.operators.select import clean_set
from labelloop.operators.train import (BATCH, RAMPUP, TEMP_U, consistency_kl, grad_at_zero, minibatch_bucket,
                                       mix_lambda, mixup_loss, mixup_pairs, nan_safe_mean, rampup_weight,
                                       softlabel_rows)
from labelloop.session import scratch_dir, stored
from labelloop.sources.commits import Commits
from labelloop.plans import fixtures as fx
from labelloop.plans.q_selection import SQL_GMM
from labelloop.plans.registry import register

EPOCH = 4          # past the 3 warm-up epochs, so the mixture gates training
W = rampup_weight(EPOCH)


def sql_u(x: str, seed: int) -> str:
    """The shared hash in DuckDB (see vectors.hash_unit)."""
    return f"((CAST('0x' || substr(md5(CAST({x} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def training_base(spark, sf_dir):
    """(id, label, embedding, embedding_bt, logits, logits_bt, p, p_bt, valid, chosen)."""
    anno = fx.noisy_annotation(spark, sf_dir)
    head = centroid_head(anno, fx.NUM_CLASSES, label_col="anno")
    s = add_scores(score(anno.withColumn("embedding_bt", fx.view2()), head), label_col="anno")
    s = score(s, head, vec_col="embedding_bt", out_col="logits_bt")
    s = clean_set(scaled_loss(s))
    return s.select("id", F.col("anno").alias("label"), "embedding", "embedding_bt", "logits", "logits_bt",
                    V.softmax("logits").alias("p"), V.softmax("logits_bt").alias("p_bt"), "valid", "chosen")


SQL_BASE = SQL_GMM + f""",
zbt AS (SELECT l.id, c.cls, sum((0.9 * a.v[l.pos + 1] + 0.1 * a.v[len(a.v) - l.pos]) * c.m) AS z
        FROM fx_long l JOIN fx_anno a ON a.id = l.id JOIN fx_centroid c ON l.pos = c.pos GROUP BY l.id, c.cls),
zb AS (SELECT id, list(z ORDER BY cls) AS logits_bt FROM zbt GROUP BY id),
tr AS (SELECT f.id, f.anno AS label, f.v,
              list_transform(range(1, len(f.v) + 1), lambda i: 0.9 * f.v[i] + 0.1 * f.v[len(f.v) + 1 - i]) AS v_bt,
              f.logits, zb.logits_bt,
              list_transform(f.logits, lambda t: exp(t - list_max(f.logits))
                 / list_sum(list_transform(f.logits, lambda u: exp(u - list_max(f.logits))))) AS p,
              list_transform(zb.logits_bt, lambda t: exp(t - list_max(zb.logits_bt))
                 / list_sum(list_transform(zb.logits_bt, lambda u: exp(u - list_max(zb.logits_bt))))) AS p_bt,
              f.valid, coalesce(post.prob > 0.7, false) AS chosen
       FROM fx_scored f JOIN zb ON zb.id = f.id LEFT JOIN post ON post.id = f.id),
cnts AS (SELECT count(*) AS n, sum(CASE WHEN valid AND chosen THEN 1 ELSE 0 END) AS nc,
                sum(CASE WHEN valid AND NOT chosen THEN 1 ELSE 0 END) AS nu FROM tr),
nb AS (SELECT {BATCH}.0 * nc / n AS nb, CAST(greatest(1, ceil(nc / 1000.0)) AS BIGINT) AS nbk FROM cnts),
cl AS (SELECT * FROM tr WHERE valid AND chosen),
hb AS (SELECT id, CAST(floor({sql_u('id', 1)} * nbk) AS BIGINT) AS bucket, {sql_u('id', 2)} AS u2 FROM cl, nb),
ra AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) AS r FROM hb),
rb AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY u2, id) AS r FROM hb),
pairs AS (SELECT ra.id, rb.id AS partner, ra.bucket FROM ra JOIN rb ON ra.bucket = rb.bucket AND ra.r = rb.r),
lamb AS (SELECT bucket, greatest(g1 / (g1 + g2), 1 - g1 / (g1 + g2)) AS lam FROM (
           SELECT DISTINCT bucket,
                  -ln({sql_u('bucket', 101)} * {sql_u('bucket', 102)} * {sql_u('bucket', 103)} * {sql_u('bucket', 104)}) AS g1,
                  -ln({sql_u('bucket', 105)} * {sql_u('bucket', 106)} * {sql_u('bucket', 107)} * {sql_u('bucket', 108)}) AS g2
           FROM pairs)),
mx AS (SELECT p.id, p.partner, l.lam, a.label AS ya, b.label AS yb,
              list_transform(range(1, len(a.v) + 1), lambda i: l.lam * a.v[i] + (1 - l.lam) * b.v[i]) AS v_mix,
              list_transform(range(1, len(a.logits) + 1), lambda i: l.lam * a.logits[i] + (1 - l.lam) * b.logits[i]) AS z_mix,
              list_transform(range(0, {fx.NUM_CLASSES}), lambda c: l.lam * (CASE WHEN c = a.label THEN 1.0 ELSE 0.0 END)
                             + (1 - l.lam) * (CASE WHEN c = b.label THEN 1.0 ELSE 0.0 END)) AS t_mix
       FROM pairs p JOIN lamb l ON l.bucket = p.bucket JOIN cl a ON a.id = p.id JOIN cl b ON b.id = p.partner),
rows AS (
  SELECT 'ce' AS kind, id, list_append(v, 1.0) AS features, label AS target, 1.0 / nb AS weight FROM cl, nb
  UNION ALL SELECT 'ce_bt', id, list_append(v_bt, 1.0), label, {W} / nb FROM cl, nb
  UNION ALL SELECT 'mix_a', id, list_append(v_mix, 1.0), ya, {W} / nb * lam FROM mx, nb
  UNION ALL SELECT 'mix_b', id, list_append(v_mix, 1.0), yb, {W} / nb * (1 - lam) FROM mx, nb
  UNION ALL SELECT 'kl', id, list_append(list_transform(v, lambda t: t / {TEMP_U}), 1.0 / {TEMP_U}),
                   CAST(UNNEST(range(0, {fx.NUM_CLASSES})) AS INTEGER), NULL FROM tr WHERE valid AND NOT chosen
  UNION ALL SELECT 'kl_bt', id, list_append(list_transform(v_bt, lambda t: t / {TEMP_U}), 1.0 / {TEMP_U}),
                   CAST(UNNEST(range(0, {fx.NUM_CLASSES})) AS INTEGER), NULL FROM tr WHERE valid AND NOT chosen),
rows_w AS (
  SELECT r.kind, r.id, r.features, r.target,
         coalesce(r.weight, CASE WHEN r.kind = 'kl' THEN {W} * 0.5 * t.p_bt[r.target + 1]
                                 ELSE {W} * 0.5 * t.p[r.target + 1] END) AS weight
  FROM rows r JOIN tr t ON t.id = r.id)"""


def _rows(spark, sf_dir):
    return softlabel_rows(training_base(spark, sf_dir), fx.NUM_CLASSES, epoch=EPOCH, seed=0)


@register("q_minibatch_buckets", f"""
SELECT vec_id AS id, CAST(floor({sql_u('vec_id', 1001)} * ceil(count(*) OVER () / {BATCH}.0)) AS BIGINT) AS batch
FROM embeddings""")
def q_minibatch_buckets(spark, sf_dir):
    """Seeded mini-batch of every training row for epoch 1."""
    v = fx.vectors(spark, sf_dir)
    n = v.count()
    return v.select("id", minibatch_bucket("id", 1, n).alias("batch"))


@register("q_mixup_pairs", SQL_BASE + """
SELECT id, partner FROM pairs""")
def q_mixup_pairs(spark, sf_dir):
    """Mixup partner of every clean row (permutation within hash buckets)."""
    base = training_base(spark, sf_dir).filter("valid AND chosen")
    return mixup_pairs(base).select("id", "partner")


@register("q_mix_lambda", SQL_BASE + """
SELECT bucket, round(lam, 6) AS lam FROM lamb""")
def q_mix_lambda(spark, sf_dir):
    """mixing coefficient max(l, 1-l), l ~ Beta(4, 4), one per bucket."""
    base = training_base(spark, sf_dir).filter("valid AND chosen")
    return mixup_pairs(base).select("bucket").distinct().select("bucket", F.round(mix_lambda(), 6).alias("lam"))


@register("q_softlabel_rows", SQL_BASE + """
SELECT kind, count(*) AS n, round(sum(weight), 6) AS weight_sum FROM rows_w WHERE weight > 0 GROUP BY kind""")
def q_softlabel_rows(spark, sf_dir):
    """Weighted soft-label training rows per loss term."""
    return _rows(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"),
                                                    F.round(F.sum("weight"), 6).alias("weight_sum"))


@register("q_head_grad_step", SQL_BASE + f""",
gl AS (SELECT target, weight, UNNEST(range(0, len(features))) AS dim, UNNEST(features) AS x FROM rows_w WHERE weight > 0),
ge AS (SELECT gl.*, c.cls FROM gl CROSS JOIN (SELECT UNNEST(range(0, {fx.NUM_CLASSES})) AS cls) c)
SELECT CAST(cls AS INTEGER) AS cls, CAST(dim AS INTEGER) AS dim,
       round(sum(weight * ({1.0 / fx.NUM_CLASSES} - CASE WHEN cls = target THEN 1.0 ELSE 0.0 END) * x), 6) AS grad
FROM ge GROUP BY cls, dim""")
def q_head_grad_step(spark, sf_dir):
    """L6 check: gradient of the whole objective at zero weights."""
    g = grad_at_zero(_rows(spark, sf_dir), fx.NUM_CLASSES)
    return g.select(F.col("cls").cast("int"), F.col("dim").cast("int"), F.round("grad", 6).alias("grad"))


@register("q_mixup_loss", SQL_BASE + """
SELECT round(-avg(list_sum(list_transform(range(1, len(z_mix) + 1), lambda i:
         (z_mix[i] - (list_max(z_mix) + ln(list_sum(list_transform(z_mix, lambda u: exp(u - list_max(z_mix)))))))
         * t_mix[i]))), 6) AS mix_loss FROM mx""")
def q_mixup_loss(spark, sf_dir):
    """Soft-target cross-entropy of mixed pairs under the current head."""
    base = training_base(spark, sf_dir).filter("valid AND chosen")
    pairs = mixup_pairs(base).withColumn("lam", mix_lambda())
    a = base.select("id", F.col("logits").alias("za"), F.col("label").alias("ya"))
    b = base.select(F.col("id").alias("partner"), F.col("logits").alias("zb"), F.col("label").alias("yb"))
    m = pairs.join(a, "id").join(b, "partner")
    m = m.select(V.lerp("za", "zb", F.col("lam")).alias("z_mix"),
                 V.lerp(V.one_hot("ya", fx.NUM_CLASSES), V.one_hot("yb", fx.NUM_CLASSES), F.col("lam")).alias("t_mix"))
    return mixup_loss(m).select(F.round("mix_loss", 6).alias("mix_loss"))


SQL_KL = """,
klr AS (SELECT id, logits AS z1, logits_bt AS z2 FROM tr WHERE valid AND NOT chosen),
kls AS (SELECT id,
  list_sum(list_transform(range(1, len(z1) + 1), lambda i:
     (exp(z2[i] - list_max(z2)) / list_sum(list_transform(z2, lambda u: exp(u - list_max(z2)))))
     * (ln(exp(z2[i] - list_max(z2)) / list_sum(list_transform(z2, lambda u: exp(u - list_max(z2)))))
        - (z1[i] / 0.85 - (list_max(z1) / 0.85 + ln(list_sum(list_transform(z1, lambda u: exp(u / 0.85 - list_max(z1) / 0.85))))))))) AS k1,
  list_sum(list_transform(range(1, len(z1) + 1), lambda i:
     (exp(z1[i] - list_max(z1)) / list_sum(list_transform(z1, lambda u: exp(u - list_max(z1)))))
     * (ln(exp(z1[i] - list_max(z1)) / list_sum(list_transform(z1, lambda u: exp(u - list_max(z1)))))
        - (z2[i] / 0.85 - (list_max(z2) / 0.85 + ln(list_sum(list_transform(z2, lambda u: exp(u / 0.85 - list_max(z2) / 0.85))))))))) AS k2
  FROM klr)"""


@register("q_consistency_kl", SQL_BASE + SQL_KL + """
SELECT round(0.5 * sum(k1) + 0.5 * sum(k2), 6) AS kl_sum FROM kls""")
def q_consistency_kl(spark, sf_dir):
    """Symmetric KL sum over the un-chosen valid rows (student / 0.85)."""
    un = training_base(spark, sf_dir).filter("valid AND NOT chosen")
    return consistency_kl(un).select(F.round("kl_sum", 6).alias("kl_sum"))


@register("q_total_loss", SQL_BASE + SQL_KL + f""",
ce AS (SELECT avg(list_max(logits) + ln(list_sum(list_transform(logits, lambda u: exp(u - list_max(logits)))))
                  - logits[label + 1]) AS ce,
              avg(list_max(logits_bt) + ln(list_sum(list_transform(logits_bt, lambda u: exp(u - list_max(logits_bt)))))
                  - logits_bt[label + 1]) AS ce_bt FROM cl),
mixl AS (SELECT -avg(list_sum(list_transform(range(1, len(z_mix) + 1), lambda i:
         (z_mix[i] - (list_max(z_mix) + ln(list_sum(list_transform(z_mix, lambda u: exp(u - list_max(z_mix)))))))
         * t_mix[i]))) AS mix FROM mx),
kl AS (SELECT 0.5 * sum(k1) + 0.5 * sum(k2) AS kl FROM kls)
SELECT round(ce + {W} * mix + {W} * (ce_bt + kl), 6) AS total_loss FROM ce, mixl, kl""")
def q_total_loss(spark, sf_dir):
    """CE + w*mixup + w*(CE on paraphrases + KL) at epoch 4 (w = 0.4)."""
    base = training_base(spark, sf_dir)
    clean = base.filter("valid AND chosen")
    ce = clean.agg(F.avg(V.cross_entropy("logits", "label")).alias("ce"),
                   F.avg(V.cross_entropy("logits_bt", "label")).alias("ce_bt")).first()
    kl = consistency_kl(base.filter("valid AND NOT chosen")).first()["kl_sum"]
    pairs = mixup_pairs(clean).withColumn("lam", mix_lambda())
    a = clean.select("id", F.col("logits").alias("za"), F.col("label").alias("ya"))
    b = clean.select(F.col("id").alias("partner"), F.col("logits").alias("zb"), F.col("label").alias("yb"))
    m = pairs.join(a, "id").join(b, "partner").select(
        V.lerp("za", "zb", F.col("lam")).alias("z_mix"),
        V.lerp(V.one_hot("ya", fx.NUM_CLASSES), V.one_hot("yb", fx.NUM_CLASSES), F.col("lam")).alias("t_mix"))
    mix = mixup_loss(m).first()["mix_loss"]
    total = ce["ce"] + W * mix + W * (ce["ce_bt"] + kl)
    return spark.createDataFrame([(round(total, 6),)], "total_loss double")


@register("q_nan_safe_mean", "WITH " + fx.SQL_SCORED + """
SELECT round(avg(loss), 6) AS mean_loss, count(loss) AS n_finite FROM fx_scored WHERE valid""")
def q_nan_safe_mean(spark, sf_dir):
    """Mean loss with NaN values (invalid rows here) skipped."""
    s = fx.scored(spark, sf_dir).withColumn("loss", F.when(F.col("valid"), F.col("loss"))
                                            .otherwise(F.lit(float("nan"))))
    return nan_safe_mean(s).select(F.round("mean_loss", 6).alias("mean_loss"), "n_finite")


STEPS, RATE = 2, 0.002


def sql_descent(steps: int, rate: float) -> str:
    """``steps`` gradient steps from zero over the weighted rows: hw{steps} (cls, dim, w)."""
    dims = f"(SELECT UNNEST(range(0, {fx.NUM_CLASSES})) AS cls), (SELECT UNNEST(range(0, len(features))) AS dim FROM (SELECT features FROM rows_w LIMIT 1))"
    out = f""",
rx AS (SELECT kind, id, any_value(features) AS features, sum(weight) AS mass FROM rows_w WHERE weight > 0 GROUP BY kind, id),
rl AS (SELECT kind, id, mass, UNNEST(range(0, len(features))) AS dim, UNNEST(features) AS x FROM rx),
tl AS (SELECT w.target AS cls, rl.dim, sum(w.weight * rl.x) AS g FROM rows_w w JOIN rl ON rl.kind = w.kind AND rl.id = w.id WHERE w.weight > 0 GROUP BY w.target, rl.dim),
hw0 AS (SELECT cls, dim, 0.0::DOUBLE AS w FROM {dims})"""
    for k in range(steps):
        out += f""",
hz{k} AS (SELECT rl.kind, rl.id, h.cls, sum(rl.x * h.w) AS z FROM rl JOIN hw{k} h ON h.dim = rl.dim GROUP BY rl.kind, rl.id, h.cls),
hm{k} AS (SELECT kind, id, max(z) AS m FROM hz{k} GROUP BY kind, id),
hs{k} AS (SELECT z.kind, z.id, sum(exp(z.z - m.m)) AS s, any_value(m.m) AS m FROM hz{k} z JOIN hm{k} m ON m.kind = z.kind AND m.id = z.id GROUP BY z.kind, z.id),
hp{k} AS (SELECT z.kind, z.id, z.cls, exp(z.z - s.m) / s.s AS p FROM hz{k} z JOIN hs{k} s ON s.kind = z.kind AND s.id = z.id),
hg{k} AS (SELECT p.cls, rl.dim, sum(rl.mass * p.p * rl.x) AS g FROM hp{k} p JOIN rl ON rl.kind = p.kind AND rl.id = p.id GROUP BY p.cls, rl.dim),
hw{k + 1} AS (SELECT h.cls, h.dim, h.w - {rate} * (g.g - coalesce(tl.g, 0)) AS w FROM hw{k} h JOIN hg{k} g ON g.cls = h.cls AND g.dim = h.dim
              LEFT JOIN tl ON tl.cls = h.cls AND tl.dim = h.dim)"""
    return out


def _objective(spark, sf_dir):
    base = stored(training_base(spark, sf_dir), "base")
    return base, Objective.of(training_table(base, epoch=EPOCH, seed=0), fx.NUM_CLASSES, base.count(), epoch=EPOCH)


@register("q_head_descent", SQL_BASE + sql_descent(STEPS, RATE) + f"""
SELECT CAST(cls AS INTEGER) AS cls, CAST(dim AS INTEGER) AS dim, round(w, 6) AS weight FROM hw{STEPS}""")
def q_head_descent(spark, sf_dir):
    """The head after a fixed number of gradient steps of the whole objective."""
    _, objective = _objective(spark, sf_dir)
    return head_table(spark, descend(objective, STEPS, RATE)).select("cls", F.posexplode("weights").alias("dim", "weight")).select(
        "cls", "dim", F.round("weight", 6).alias("weight"))


def sql_epoch_eval(k: int) -> str:
    return f"""SELECT {k} AS epoch, CAST(arg_max(cls, (z, -cls)) AS INTEGER) = gold AS hit FROM (
  SELECT a.id, a.gold, h.cls, sum(a.x * h.w) AS z FROM (SELECT id, gold, UNNEST(range(0, len(v) + 1)) AS dim, UNNEST(list_append(v, 1.0)) AS x FROM fx_anno) a
  JOIN hw{k} h ON h.dim = a.dim GROUP BY a.id, a.gold, h.cls) GROUP BY id, gold"""


@register("q_epoch_evaluation", SQL_BASE + sql_descent(STEPS, RATE) + f""",
ev AS ({" UNION ALL ".join(sql_epoch_eval(k) for k in range(1, STEPS + 1))})
SELECT 1 AS round, CAST(epoch AS INTEGER) AS epoch, 'eval_accuracy' AS key, printf('%.6f', avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)) AS value FROM ev GROUP BY epoch
UNION ALL SELECT 1, CAST(epoch AS INTEGER), 'eval_n', CAST(count(*) AS VARCHAR) FROM ev GROUP BY epoch""")
def q_epoch_evaluation(spark, sf_dir):
    """L7 after every epoch: the evaluation table of heads of one and two gradient steps,
    keyed by (round, epoch) and committed like in the loop."""
    from labelloop.plans.loop import evaluation
    _, objective = _objective(spark, sf_dir)
    gold = stored(fx.noisy_annotation(spark, sf_dir).select("gold", "embedding"), "gold")
    commits = Commits(spark, scratch_dir(spark, "evaluations"))
    for epoch in range(1, STEPS + 1):
        commits.table(f"eval/1/{epoch}", lambda: evaluation(gold, descend(objective, epoch, RATE), 1, epoch))  # noqa: B023 - runs at once
    return spark.read.parquet(*commits.steps().values())


@register("q_rampup", f"""
SELECT epoch, round(CASE WHEN length = 0 THEN 1.0 ELSE least(1.0, epoch / length) END, 6) AS weight, length, n FROM (
  SELECT vec_id % 14 AS epoch, (CASE WHEN label = 0 THEN 0 ELSE {RAMPUP} END)::INTEGER AS length, count(*) AS n
  FROM embeddings GROUP BY vec_id % 14, CASE WHEN label = 0 THEN 0 ELSE {RAMPUP} END)""")
def q_rampup(spark, sf_dir):
    """the ramp-up weight of each training row's epoch, also for length zero."""
    x = fx.vectors(spark, sf_dir).select((F.col("id") % 14).alias("epoch"), F.when(F.col("label") == 0, 0).otherwise(RAMPUP).alias("length"))
    return (x.withColumn("weight", F.round(V.linear_rampup("epoch", F.col("length")), 6)).groupBy("epoch", "weight", "length")
            .agg(F.count(F.lit(1)).alias("n")))


@register("q_self_train")
def q_self_train(spark, sf_dir):
    """One self-training round - training table -> L-BFGS over its objective ->
    new head -> predictions for every row (iterative fit: rows-only check)."""
    base, objective = _objective(spark, sf_dir)
    scored = add_scores(score(base.select("id", "label", "embedding"), fit(objective, max_iter=50)), label_col="label")
    return scored.select("id", "pred", "label")


@register("q_scatter", "WITH " + fx.SQL_SCORED + """
SELECT id, pred, round(conf, 6) AS conf FROM fx_scored""")
def q_scatter(spark, sf_dir):
    """Per-batch scores land in a table keyed by id (no positional scatter);
    a duplicate id is an error."""
    from labelloop.operators.score import assert_unique
    s = fx.scored(spark, sf_dir)
    return assert_unique(s, "id").select("id", "pred", F.round("conf", 6).alias("conf"))


@register("q_gather_mask", SQL_BASE + f""",
mb AS (SELECT id, CAST(floor({sql_u('id', 1000 + EPOCH)} * ceil((SELECT count(*) FROM tr) / {BATCH}.0)) AS BIGINT) AS batch
       FROM tr)
SELECT mb.id, mb.batch, tr.valid AND tr.chosen AS clean, tr.valid AND NOT tr.chosen AS unchosen
FROM mb JOIN tr ON tr.id = mb.id""")
def q_gather_mask(spark, sf_dir):
    """The chosen mask gathered onto every mini-batch row (equi join on id)."""
    base = training_base(spark, sf_dir)
    n = base.count()
    batches = base.select("id", minibatch_bucket("id", EPOCH, n).alias("batch"))
    mask = base.select("id", (F.col("valid") & F.col("chosen")).alias("clean"),
                       (F.col("valid") & ~F.col("chosen")).alias("unchosen"))
    return batches.join(mask, "id")
