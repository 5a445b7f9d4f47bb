"""Catalogue: scans and sinks (S1-S5, S7, S8, S13-S18), augmentation (X3, J10,
L9, P9, P10), evaluation (A1, L7, L8, P12), small projections (P1, P16, O1),
label merge (J14) and the outer loop (L10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.functions.vectors import hash_unit
from labelloop.operators import tokenize as TK
from labelloop.operators.augment import attach_paraphrase, augment, collate, has_paraphrase, swap_pairs
from labelloop.operators.metrics import eval_report, write_report
from labelloop.operators.score import centroid_head, score
from labelloop.plans import fixtures as fx
from labelloop.plans.q_labelling import SQL_INITIAL, TASK
from labelloop.plans.q_text import SQL_ENC, SQL_PIECES, W_VOCAB, sql_norm
from labelloop.plans.q_training import sql_u
from labelloop.plans.registry import register
from labelloop.session import scratch_dir, stored
from labelloop.sources.tables import (assign_ids, cached, examples, parse_vector, read_labelled_csv, read_split,
                                      read_vocab, write_predictions, write_split_table, write_vocab)

CSV_OPTS = {"escape": '"', "header": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df, path, mode="overwrite"):
    w = df.write.mode(mode)
    for k, v in CSV_OPTS.items():
        w = w.option(k, v)
    w.csv(path)


def split_col(id_col="id"):
    """fx_split by a seeded hash of the id: 80 % train, 10 % dev, 10 % test."""
    u = hash_unit(id_col, 7)
    return F.when(u < 0.8, F.lit("train")).when(u < 0.9, F.lit("dev")).otherwise(F.lit("test"))


SQL_SPLIT = f"CASE WHEN {sql_u('id', 7)} < 0.8 THEN 'train' WHEN {sql_u('id', 7)} < 0.9 THEN 'dev' ELSE 'test' END"
SQL_PARA = "WITH " + fx.SQL_CORPUS + f""",
fx_para AS (SELECT id, text, label, CASE WHEN label IS NOT NULL AND {sql_u('id', 9)} < 0.25 THEN lower(text) END AS text_bt FROM fx_corpus),
sw AS (SELECT id, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM fx_para),
swapped AS (SELECT id, CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(range(0, len(ws)), lambda i:
              CASE WHEN i % 2 = 0 AND i + 1 < len(ws) THEN ws[i + 2] WHEN i % 2 = 1 THEN ws[i] ELSE ws[i + 1] END), ' ')
              ELSE '' END AS para FROM sw),
aug AS (SELECT p.id, p.label, p.text, coalesce(p.text_bt, s.para) AS text_bt FROM fx_para p JOIN swapped s ON s.id = p.id)"""


def para_table(spark, sf_dir):
    """fx_paraphrase: a quarter of the rows (by hash) already carry a paraphrase."""
    c = fx.text_corpus(spark, sf_dir)
    return c.withColumn("text_bt", F.when(F.col("label").isNotNull() & (hash_unit("id", 9) < 0.25),
                                          F.lower("text")))


def _write_ragged(df, path):
    """Rows with a paraphrase as (label, text, text_bt) - an empty label field
    when there is none -, labelled rows as (label, text), the rest as (text)."""
    with_bt = df.filter(F.col("text_bt").isNotNull())
    no_bt = df.filter(F.col("text_bt").isNull() & F.col("label").isNotNull())
    write_csv(with_bt.select(F.col("label").cast("string"), "text", "text_bt"), path)
    write_csv(no_bt.select(F.col("label").cast("string"), "text"), path, mode="append")
    write_csv(df.filter(F.col("text_bt").isNull() & F.col("label").isNull()).select("text"), path, mode="append")


@register("q_csv_scan", "WITH " + fx.SQL_CORPUS + """
SELECT label, text FROM fx_corpus""")
def q_csv_scan(spark, sf_dir):
    """Ragged header-less CSV (1 or 2 columns) read back with quoted newlines."""
    path = scratch_dir(spark, "csv")
    c = fx.text_corpus(spark, sf_dir).withColumn("text_bt", F.lit(None).cast("string"))
    _write_ragged(c, path)
    rows, _ = read_labelled_csv(spark, path, "train")
    return rows.select("label", "text")


@register("q_aug_scan", SQL_PARA + """
SELECT label, text, text_bt FROM fx_para""")
def q_aug_scan(spark, sf_dir):
    """Augmented-split CSV: the third column is kept as the paraphrase."""
    path = scratch_dir(spark, "aug_csv")
    _write_ragged(para_table(spark, sf_dir), path)
    rows, _ = read_labelled_csv(spark, path, "train_chat")
    return rows.select("label", "text", "text_bt")


@register("q_augment", SQL_PARA + """
SELECT label, text, text_bt FROM aug""")
def q_augment(spark, sf_dir):
    """CSV in -> paraphrase rows without one -> attach -> CSV out (S16) -> read back."""
    src = scratch_dir(spark, "aug_in")
    _write_ragged(para_table(spark, sf_dir), src)
    rows, _ = read_labelled_csv(spark, src, "train_chat")
    out = augment(assign_ids(rows))
    dst = scratch_dir(spark, "aug_out")
    _write_ragged(out, dst)
    back, _ = read_labelled_csv(spark, dst, "train_chat")
    return back.select("label", "text", "text_bt")


@register("q_aug_sink", SQL_PARA + """
SELECT id, label, text_bt FROM aug""")
def q_aug_sink(spark, sf_dir):
    """Augmented table written with every original column and read back."""
    path = scratch_dir(spark, "aug_parquet")
    augment(para_table(spark, sf_dir)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("id", "label", "text_bt")


@register("q_paraphrase", SQL_PARA + """
SELECT id, para AS text_bt FROM swapped""")
def q_paraphrase(spark, sf_dir):
    """X3 (built-in paraphraser): adjacent words swapped pairwise."""
    return fx.text_corpus(spark, sf_dir).select("id", swap_pairs("text").alias("text_bt"))


@register("q_attach_paraphrase", SQL_PARA + """
SELECT id, text_bt FROM aug""")
def q_attach_paraphrase(spark, sf_dir):
    """Existing paraphrases kept, missing ones attached (only those are generated)."""
    return attach_paraphrase(para_table(spark, sf_dir), swap_pairs("text")).select("id", "text_bt")


@register("q_aug_presence", SQL_PARA + """
SELECT id, text_bt IS NOT NULL AS augmented FROM fx_para""")
def q_aug_presence(spark, sf_dir):
    """A row is augmented when it carries a paraphrase."""
    return para_table(spark, sf_dir).select("id", has_paraphrase().alias("augmented"))


@register("q_examples", SQL_PARA + """
SELECT id, label, text_bt IS NOT NULL AS has_bt FROM aug""")
def q_examples(spark, sf_dir):
    """S3: examples of the augmented split (paraphrase mandatory; none rejected after L9)."""
    good, rejected = examples(augment(para_table(spark, sf_dir)), "train_chat")
    if rejected.limit(1).count():
        raise ValueError("augmented rows without paraphrase")
    return good.select("id", "label", F.col("text_bt").isNotNull().alias("has_bt"))


SQL_COLLATE = SQL_ENC + ",\n" + SQL_PARA.split("WITH ", 1)[1].split(",\n", 1)[1] + ",\n" + \
    sql_norm("(SELECT id, text_bt AS text FROM aug)").replace("norm AS", "norm_bt AS", 1) + ",\n" + \
    SQL_PIECES.replace("pc AS", "pc_bt AS", 1).replace("FROM norm)", "FROM norm_bt)") + """,
lp_bt AS (SELECT id, UNNEST(range(0, len(pieces))) AS pos, UNNEST(pieces) AS token FROM pc_bt),
n_bt AS (SELECT id, least(len(pieces), 126) AS k FROM pc_bt),
enc_bt AS (
  SELECT id, 0 AS pos, 2 AS token_id, 1 AS mask FROM n_bt
  UNION ALL SELECT l.id, l.pos + 1, coalesce(v.token_id, 1), 1 FROM lp_bt l LEFT JOIN vocab v ON v.token = l.token WHERE l.pos < 126
  UNION ALL SELECT id, k + 1, 3, 1 FROM n_bt
  UNION ALL SELECT n_bt.id, r.p, 0, 0 FROM n_bt CROSS JOIN range(0, 128) r(p) WHERE r.p > n_bt.k + 1)"""


@register("q_collate", SQL_COLLATE + """
SELECT a.id, CAST(a.pos AS BIGINT) AS pos, CAST(a.token_id AS INTEGER) AS input_id, CAST(a.mask AS INTEGER) AS mask,
       CAST(b.token_id AS INTEGER) AS input_id_bt, CAST(b.mask AS INTEGER) AS mask_bt, g.label
FROM enc a JOIN enc_bt b ON b.id = a.id AND b.pos = a.pos JOIN aug g ON g.id = a.id""")
def q_collate(spark, sf_dir):
    """P10: the batch columns of the augmented split, both texts' inputs position by position."""
    vocab = TK.build_vocab(fx.documents_text(spark, sf_dir))
    aug = stored(augment(para_table(spark, sf_dir)), "augmented")
    a = TK.encode(aug, vocab, "text")
    b = TK.encode(aug, vocab, "text_bt").select("id", F.col("input_ids").alias("input_ids_bt"), F.col("attention_mask").alias("attention_mask_bt"))
    c = collate(a.join(b, "id").join(aug.select("id", "label"), "id"), with_bt=True)
    z = c.select("id", "label", F.posexplode(F.arrays_zip("input_ids", "attention_mask", "input_ids_bt", "attention_mask_bt")).alias("pos", "z"))
    return z.select("id", F.col("pos").cast("bigint").alias("pos"), F.col("z.input_ids").alias("input_id"), F.col("z.attention_mask").alias("mask"),
                    F.col("z.input_ids_bt").alias("input_id_bt"), F.col("z.attention_mask_bt").alias("mask_bt"), "label")


@register("q_split_scan", "WITH " + fx.SQL_CORPUS + f"""
SELECT id, label FROM fx_corpus WHERE {SQL_SPLIT} = 'dev'""")
def q_split_scan(spark, sf_dir):
    """Split table partitioned by split; reading 'dev' prunes to one folder."""
    path = scratch_dir(spark, "splits")
    write_split_table(fx.text_corpus(spark, sf_dir).withColumn("split", split_col()), path)
    return read_split(spark, path, "dev").select("id", "label")


@register("q_assign_id", """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS id, doc_id FROM documents""")
def q_assign_id(spark, sf_dir):
    """Position ids assigned once at ingest (zipWithIndex in scan order)."""
    return assign_ids(fx.table(spark, sf_dir, "documents").select("doc_id"))


@register("q_parse_vector", """
SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM embeddings""")
def q_parse_vector(spark, sf_dir):
    """Vectors stored as list-literal text parsed back with from_json."""
    e = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.to_json(F.col("embedding").cast("array<double>")).alias("embedding_text"))
    v = e.select("id", parse_vector("embedding_text").alias("v"))
    return v.select("id", F.size("v").alias("dims"),
                    F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("q_unlabelled", """
SELECT d.doc_id AS id, CAST(len(e.embedding) AS INTEGER) AS dims FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_unlabelled(spark, sf_dir):
    """Corpus rows without a label yet, with the size of their vector (NULL: none)."""
    tv = fx.text_vectors(spark, sf_dir)
    lab = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return tv.join(lab, "id", "left_anti").select("id", F.size("embedding").alias("dims"))


@register("q_feature_cache", SQL_ENC + """
SELECT id, CAST(sum(token_id) AS BIGINT) AS ids_sum, CAST(sum(mask) AS BIGINT) AS n_real FROM enc GROUP BY id""")
def q_feature_cache(spark, sf_dir):
    """Encoded features cached by (mode, tokenizer, max_len, task) and the input's
    files; the second call reads the stage table instead of re-encoding."""
    root = scratch_dir(spark, "features")
    corpus = fx.documents_text(spark, sf_dir)
    key = {"mode": "train", "tokenizer": "wordpiece", "max_len": 128, "task": "corpus"}

    def build():
        return TK.encode(corpus, TK.build_vocab(corpus), max_length=128)
    cached(spark, root, key, corpus, build)
    feats = cached(spark, root, key, corpus, build)
    return feats.select("id", F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("ids_sum"),
                        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_real"))


@register("q_vocab_sink", W_VOCAB + """
SELECT token_id, token FROM vocab""")
def q_vocab_sink(spark, sf_dir):
    """Vocabulary written one token per line in id order."""
    path = scratch_dir(spark, "vocab")
    write_vocab(TK.build_vocab(fx.documents_text(spark, sf_dir)), path)
    return read_vocab(spark, path).select("token_id", "token")


@register("q_vocab_scan", W_VOCAB + """
SELECT token, token_id FROM vocab""")
def q_vocab_scan(spark, sf_dir):
    """Vocabulary file read back: stripped line -> id = line number."""
    path = scratch_dir(spark, "vocab")
    write_vocab(TK.build_vocab(fx.documents_text(spark, sf_dir)), path)
    return read_vocab(spark, path)


def _predictions(spark, sf_dir):
    anno = fx.noisy_annotation(spark, sf_dir)
    head = centroid_head(anno, fx.NUM_CLASSES, label_col="anno")
    from labelloop.functions.vectors import argmax
    return score(anno, head).select("id", argmax("logits").alias("pred"), F.col("gold").alias("label"))


SQL_PRED = "WITH " + fx.SQL_SCORED


@register("q_predictions", SQL_PRED + """
SELECT id, pred, gold AS label FROM fx_scored""")
def q_predictions(spark, sf_dir):
    """Predictions (argmax of the head) with the truth, written and read back."""
    path = scratch_dir(spark, "predictions")
    write_predictions(_predictions(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("q_eval_report", SQL_PRED + """
SELECT 'eval_accuracy' AS key, printf('%.6f', avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END)) AS value FROM fx_scored
UNION ALL SELECT 'eval_n', CAST(count(*) AS VARCHAR) FROM fx_scored""")
def q_eval_report(spark, sf_dir):
    """Accuracy report as key = value rows, written and read back."""
    path = scratch_dir(spark, "report")
    write_report(eval_report(_predictions(spark, sf_dir)), path)
    return spark.read.schema("key string, value string, line string").json(path).select("key", "value")


def evaluation_target(rows, setting: str):
    """Transductive -> evaluate on the training split, inductive -> test."""
    if setting == "transductive":
        return rows.filter(F.col("split") == "train")
    if setting == "inductive":
        return rows.filter(F.col("split") == "test")
    raise ValueError(f"unknown learning setting {setting!r}")


@register("q_eval_target", SQL_PRED + f"""
SELECT 'transductive' AS setting, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM fx_scored WHERE {SQL_SPLIT} = 'train'
UNION ALL SELECT 'inductive', round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6), count(*)
FROM fx_scored WHERE {SQL_SPLIT} = 'test'""")
def q_eval_target(spark, sf_dir):
    """The evaluation table depends on the learning setting."""
    from labelloop.operators.metrics import accuracy
    p = _predictions(spark, sf_dir).withColumn("split", split_col())
    out = None
    for setting in ("transductive", "inductive"):
        a = accuracy(evaluation_target(p, setting)).select(
            F.lit(setting).alias("setting"), F.round("accuracy", 6).alias("accuracy"), "n")
        out = a if out is None else out.unionByName(a)
    return out


def range_slice(df, start_idx, id_col="id"):
    """Rows from ``start_idx`` on (pushed down to the scan), ids kept."""
    return df.filter(F.col(id_col) >= start_idx)


@register("q_range_slice", """
SELECT vec_id AS id, vec_id >= (SELECT avg(vec_id) FROM embeddings) AS resumed FROM embeddings WHERE vec_id >= 0""")
def q_range_slice(spark, sf_dir):
    """Rows from start_idx to the end, ids kept: from 0 (the reference default)
    and, marked ``resumed``, from the middle of the ids."""
    v = fx.vectors(spark, sf_dir)
    middle = v.agg(F.avg("id")).first()[0]
    rest = range_slice(v, middle).select(F.col("id").alias("_id"))
    return range_slice(v, 0).join(rest, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("resumed"))


@register("q_point_lookup", """
SELECT (SELECT count(*) FROM documents) AS n_rows, doc_id AS id, n_chars FROM documents
WHERE doc_id = (SELECT max(doc_id) FROM documents)""")
def q_point_lookup(spark, sf_dir):
    """Length of the table and a point lookup by id (the last id)."""
    d = fx.table(spark, sf_dir, "documents")
    n = d.count()
    last = d.agg(F.max("doc_id")).first()[0]
    return d.filter(F.col("doc_id") == last).select(F.lit(n).cast("bigint").alias("n_rows"),
                                                    F.col("doc_id").alias("id"), "n_chars")


@register("q_preview", SQL_ENC + """,
per AS (SELECT id, CAST(sum(mask) AS BIGINT) AS n_real FROM enc GROUP BY id)
SELECT id, n_real FROM per ORDER BY id LIMIT 2""")
def q_preview(spark, sf_dir):
    """O1: preview of the first two encoded features (top-2 by id)."""
    corpus = fx.documents_text(spark, sf_dir)
    enc = TK.encode(corpus, TK.build_vocab(corpus), max_length=128)
    return enc.select("id", F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
                      .alias("n_real")).orderBy("id").limit(2)


@register("q_merge_labels", SQL_INITIAL + """,
""" + fx.SQL_CORPUS + """
SELECT c.id, CAST(a.anno AS INTEGER) AS round_label, c.label AS quality FROM fx_corpus c JOIN ans a ON a.id = c.id""")
def q_merge_labels(spark, sf_dir):
    """The round's labels merged into the training table (see ``merge_labels``)."""
    from labelloop.plans.q_labelling import _initial
    from labelloop.plans.rounds import merge_labels
    merged = merge_labels(fx.text_corpus(spark, sf_dir), stored(_initial(spark, sf_dir), "labels"), "round_label")
    return merged.select("id", "round_label", F.col("label").alias("quality"))


@register("q_outer_loop")
def q_outer_loop(spark, sf_dir):
    """Two rounds of the outer loop (label -> augment -> train and evaluate ->
    feedback -> refine)."""
    from labelloop.plans.loop import outer_loop
    corpus = fx.text_vectors(spark, sf_dir)
    dev = corpus.filter(F.col("label").isNotNull()).select(F.col("label").alias("gold"), "text")
    return outer_loop(spark, corpus, fx.text_demo_pool(spark, sf_dir), 2, TASK, dev=dev)


SQL_SPLITS = f"""splits AS (SELECT *, {SQL_SPLIT} AS split FROM (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""


@register("q_run_order", "WITH " + SQL_SPLITS + f""",
sl AS (SELECT id, split, label, UNNEST(range(0, len(v))) AS pos, UNNEST(v) AS x FROM splits),
cent AS (SELECT label AS cls, pos, avg(x) AS m FROM sl WHERE split = 'train' GROUP BY label, pos),
z AS (SELECT sl.id, sl.split, sl.label, c.cls, sum(sl.x * c.m) AS z FROM sl JOIN cent c ON c.pos = sl.pos WHERE sl.split <> 'train' GROUP BY ALL),
best AS (SELECT id, split, label, CAST(arg_max(cls, (z, -cls)) AS INTEGER) AS pred FROM z GROUP BY ALL),
heads AS (SELECT 'trained' AS head, id, split, label, pred FROM best
          UNION ALL SELECT 'initial', id, split, label, 0 FROM splits WHERE split <> 'train'),
flags AS (SELECT UNNEST(range(1, 8)) AS f),
sets AS (SELECT CASE WHEN f & 1 = 1 THEN 't' ELSE '' END || CASE WHEN f & 2 = 2 THEN 'e' ELSE '' END || CASE WHEN f & 4 = 4 THEN 'p' ELSE '' END AS flags,
                f, CASE WHEN f & 1 = 1 THEN 'trained' ELSE 'initial' END AS head FROM flags)
SELECT flags, 'train' AS stage, 'classes' AS key, '{fx.NUM_CLASSES}' AS value FROM sets WHERE f & 1 = 1
UNION ALL SELECT flags, 'eval', 'eval_accuracy', printf('%.6f', avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END)) FROM sets JOIN heads USING (head)
          WHERE f & 2 = 2 AND split = 'dev' GROUP BY flags
UNION ALL SELECT flags, 'eval', 'eval_n', CAST(count(*) AS VARCHAR) FROM sets JOIN heads USING (head) WHERE f & 2 = 2 AND split = 'dev' GROUP BY flags
UNION ALL SELECT flags, 'predict', 'class ' || CAST(pred AS VARCHAR), CAST(count(*) AS VARCHAR) FROM sets JOIN heads USING (head)
          WHERE f & 4 = 4 AND split = 'test' GROUP BY flags, pred""")
def q_run_order(spark, sf_dir):
    """Every set of the flags train, eval, predict over a root of its own: what each
    requested stage gives, with the trained head or, without training, the initial one."""
    import numpy as np
    from labelloop.operators.score import LinearHead
    from labelloop.plans.run import Run
    v = fx.vectors(spark, sf_dir)
    splits = stored(v.withColumn("split", split_col()), "splits")
    dims = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    initial = LinearHead(np.zeros((fx.NUM_CLASSES, dims)), np.zeros(fx.NUM_CLASSES))
    out = []
    for f in range(1, 8):
        flags = "".join(name for i, name in enumerate("tep") if f >> i & 1)
        run = Run(spark, scratch_dir(spark, f"run-{flags}"), splits, lambda rows: centroid_head(rows, fx.NUM_CLASSES, label_col="label"), initial)
        got = run(do_train="t" in flags, do_eval="e" in flags, do_predict="p" in flags)
        if "train" in got:
            out.append(got["train"].agg(F.lit("classes").alias("key"), F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(flags).alias("flags"), F.lit("train").alias("stage"), "key", "value"))
        if "eval" in got:
            out.append(got["eval"].select(F.lit(flags).alias("flags"), F.lit("eval").alias("stage"), "key", "value"))
        if "predict" in got:
            out.append(got["predict"].groupBy("pred").count().select(F.lit(flags).alias("flags"), F.lit("predict").alias("stage"), F.concat(F.lit("class "), F.col("pred").cast("string")).alias("key"), F.col("count").cast("string").alias("value")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
