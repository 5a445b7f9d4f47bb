"""Catalogue: prompts, annotation, answer parsing and the labelling rounds
(F25, X1, X2, P11, P14, P15, F13, F14, W4, U1, J5, J5b, L1, L2, S11, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.functions.labels import cast_label, label_word, parse_answer, response_text
from labelloop.operators.annotate import (RateCeiling, annotate, batch_number, completion_json, majority_answer_annotator,
                                          need_annotation, trusted_override)
from labelloop.operators.answers import AnnotationLog, AnswerStore
from labelloop.operators.demos import fixed_clusters
from labelloop.operators.prompt import MOVIE_REVIEW, build_prompts, exploded_messages, generic_task
from labelloop.operators.retrieve import knn_topk
from labelloop.plans import fixtures as fx
from labelloop.plans.q_demos import SQL_LISTS
from labelloop.plans.registry import register
from labelloop.plans.rounds import (emit_feedback, initial_round, read_feedback, refinery_round,
                                    round_prompts, write_feedback, write_labels)
from labelloop.session import scratch_dir

TASK = generic_task(fx.NUM_CLASSES)


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_sentence(template: str, col: str) -> str:
    before, after = template.split("{}", 1)
    return f"'{_q(before)}' || replace({col}, chr(10), '') || '{_q(after)}'"


def _corpus(spark, sf_dir):
    """Text + vector corpus (documents joined to embeddings)."""
    return fx.text_vectors(spark, sf_dir)


def _pool(spark, sf_dir):
    return fx.text_demo_pool(spark, sf_dir)


def _initial(spark, sf_dir, annotator=majority_answer_annotator):
    return initial_round(_corpus(spark, sf_dir), _pool(spark, sf_dir), TASK, annotator)


SQL_MSGS = "WITH " + fx.SQL_KNN_TEXT + f""",
dm AS (SELECT knn.id, knn.rank, d.text AS dtext, knn.anno FROM knn JOIN documents d ON d.doc_id = knn.demo_id),
nd AS (SELECT id, count(*) AS n FROM knn GROUP BY id),
q AS (SELECT d.doc_id AS id, d.text, coalesce(nd.n, 0) AS n FROM documents d LEFT JOIN nd ON nd.id = d.doc_id),
msgs AS (
  SELECT id, 0 AS turn, 'system' AS role, '{_q(TASK.system)}' AS content FROM q
  UNION ALL SELECT id, 3 * (rank - 1) + 1, 'user', {sql_sentence(TASK.sentence_template, 'dtext')} FROM dm
  UNION ALL SELECT id, 3 * (rank - 1) + 2, 'user', '{_q(TASK.question)}' FROM dm
  UNION ALL SELECT id, 3 * (rank - 1) + 3, 'assistant', 'class' || CAST(anno AS VARCHAR) FROM dm
  UNION ALL SELECT id, 3 * n + 1, 'user', {sql_sentence(TASK.sentence_template, 'text')} FROM q
  UNION ALL SELECT id, 3 * n + 2, 'user', '{_q(TASK.question)}' FROM q)"""


@register("q_prompt_messages", SQL_MSGS + """
SELECT id, CAST(turn AS BIGINT) AS turn, role, content FROM msgs""")
def q_prompt_messages(spark, sf_dir):
    """few-shot prompts (33 messages for 10 demos, 3 without any), exploded."""
    return exploded_messages(round_prompts(_corpus(spark, sf_dir), _pool(spark, sf_dir), TASK))


SQL_INITIAL = "WITH " + fx.SQL_KNN_TEXT + """,
cnt AS (SELECT id, anno, count(*) AS c, min(rank) AS r FROM knn GROUP BY id, anno),
ans AS (SELECT id, anno FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, r) AS rn FROM cnt)
        WHERE rn = 1
        UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT id FROM knn))"""


@register("q_initial_round", SQL_INITIAL + """
SELECT id, CAST(anno AS INTEGER) AS label FROM ans""")
def q_initial_round(spark, sf_dir):
    """L1: retrieve -> prompt -> annotate (offline majority annotator) -> parse."""
    return _initial(spark, sf_dir).select("id", "label")


@register("q_annotate_retry", SQL_INITIAL + """
SELECT id, CAST(anno AS INTEGER) AS label, CAST(NULL AS VARCHAR) AS error FROM ans""")
def q_annotate_retry(spark, sf_dir):
    """The round under a rate ceiling of one call in 20 ms for each worker: calls over
    it fail and are made again after the back-off, so it equals the initial round."""
    return initial_round(_corpus(spark, sf_dir), _pool(spark, sf_dir), TASK, RateCeiling(majority_answer_annotator, 1, 0.02),
                         retries=12, base_delay=0.01).select("id", "label", "error")


@register("q_answer_store", SQL_INITIAL + """
SELECT id, CASE WHEN anno < 0 THEN '' ELSE 'class' || CAST(anno AS VARCHAR) END AS raw, CAST(anno AS INTEGER) AS label FROM ans""")
def q_answer_store(spark, sf_dir):
    """X1 with paid answers: the round is run twice over one store; the second run finds
    every answer and its annotator, which refuses, is not called."""
    store = AnswerStore(scratch_dir(spark, "answers"), 1)
    corpus, pool = _corpus(spark, sf_dir), _pool(spark, sf_dir)
    initial_round(corpus, pool, TASK, store=store).write.format("noop").mode("overwrite").save()
    return initial_round(corpus, pool, TASK, refuse, store=store).select("id", "raw", "label")


def refuse(batch):
    raise ValueError(f"{len(batch)} prompts without a stored answer")


SQL_STUB = "WITH " + fx.SQL_CORPUS + f""",
stub AS (SELECT id, ['positive', 'Negative.', 'POSITIVE..', ' negative', '', 'neutral']
           [length({sql_sentence(MOVIE_REVIEW.sentence_template, 'text')}) % 6 + 1] AS raw FROM fx_corpus)"""


def _stub_raw(spark, sf_dir):
    c = fx.text_corpus(spark, sf_dir)
    prompts = c.select("id", F.array(
        F.struct(F.lit("system").alias("role"), F.lit(MOVIE_REVIEW.system).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.lit("Given a movie review: '"), F.regexp_replace("text", "\n", ""), F.lit("'"))
                 .alias("content")),
        F.struct(F.lit("user").alias("role"), F.lit(MOVIE_REVIEW.question).alias("content"))).alias("messages"))
    return annotate(prompts, fx.length_annotator)


@register("q_annotate_stub", SQL_STUB + """
SELECT id, raw FROM stub""")
def q_annotate_stub(spark, sf_dir):
    """Annotator callable run in batches of 100 prompts (deterministic stub)."""
    return _stub_raw(spark, sf_dir).select("id", "raw")


SQL_PARSE = """CASE lower(regexp_replace(raw, '\\.$', '')) WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 ELSE -1 END"""


@register("q_parse_label", SQL_STUB + f"""
SELECT id, raw, CAST({SQL_PARSE} AS INTEGER) AS label FROM stub""")
def q_parse_label(spark, sf_dir):
    """F13 + F14: strip one trailing dot, lower-case, exact word match, else -1."""
    raw = _stub_raw(spark, sf_dir)
    return raw.select("id", "raw", parse_answer(F.col("raw"), MOVIE_REVIEW.words).alias("label"))


@register("q_response_text", SQL_STUB + """
SELECT id, raw AS content FROM stub""")
def q_response_text(spark, sf_dir):
    """Answer text out of the nested chat-completion response."""
    raw = _stub_raw(spark, sf_dir).withColumn("response", completion_json("raw"))
    return raw.select("id", response_text("response").alias("content"))


@register("q_label_word", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS word FROM labels""")
def q_label_word(spark, sf_dir):
    """Class index -> answer word."""
    lab = fx.table(spark, sf_dir, "labels")
    return lab.select("doc_id", label_word(F.col("quality"), MOVIE_REVIEW.words).alias("word"))


@register("q_cast_label", """
SELECT doc_id, TRY_CAST(CAST(quality AS VARCHAR) AS INTEGER) AS label, TRY_CAST(source AS INTEGER) AS bad
FROM labels JOIN documents USING (doc_id)""")
def q_cast_label(spark, sf_dir):
    """Label text <-> int; text that is not a number gives NULL."""
    lab = fx.table(spark, sf_dir, "labels").join(fx.table(spark, sf_dir, "documents"), "doc_id")
    return lab.select("doc_id", cast_label(F.col("quality").cast("string")).alias("label"),
                      cast_label(F.col("source")).alias("bad"))


@register("q_batch_number", """
SELECT doc_id AS id, doc_id // 100 AS batch FROM documents""")
def q_batch_number(spark, sf_dir):
    """W4 + W5: batches of 100 consecutive ids (the last one partial)."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return d.select("id", batch_number("id").alias("batch"))


SQL_REFINE = SQL_LISTS + """,
da AS (SELECT dl.id, dl.pos, f.pred AS dlab FROM dl JOIN fx_scored f ON f.id = dl.demo_id),
dc AS (SELECT id, dlab, count(*) AS c, min(pos) AS p FROM da GROUP BY id, dlab),
maj AS (SELECT id, dlab FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, p) AS rn FROM dc)
        WHERE rn = 1),
refined AS (SELECT d.doc_id AS id, CAST(CASE WHEN t.id IS NOT NULL THEN f.pred ELSE coalesce(maj.dlab, -1) END AS INTEGER)
                   AS label, t.id IS NOT NULL AS trusted
            FROM documents d LEFT JOIN fx_scored f ON f.id = d.doc_id LEFT JOIN top t ON t.id = f.id LEFT JOIN maj ON maj.id = f.id)"""


def _feedback(spark, sf_dir):
    return emit_feedback(fx.scored(spark, sf_dir), fx.NUM_CLASSES, clusterer=fixed_clusters)


@register("q_refinery_round", SQL_REFINE + """
SELECT id, label FROM refined""")
def q_refinery_round(spark, sf_dir):
    """L2: trusted rows keep the pseudo-label, the others are re-annotated with
    demonstrations chosen by the small model (feedback written and read back)."""
    root = scratch_dir(spark, "feedback")
    write_feedback(_feedback(spark, sf_dir), root, 1)
    fb = read_feedback(spark, root, 1)
    return refinery_round(_corpus(spark, sf_dir).select("id", "text"), fb, TASK).select("id", "label")


def _body(sql: str) -> str:
    """CTE list of a statement without its leading WITH."""
    return sql.split("WITH ", 1)[1]


SQL_OVERRIDE = SQL_INITIAL + ",\n" + _body(SQL_REFINE)


@register("q_trusted_override", SQL_OVERRIDE + """
SELECT ans.id, CAST(CASE WHEN t.id IS NOT NULL THEN f.pred ELSE ans.anno END AS INTEGER) AS label
FROM ans LEFT JOIN top t ON t.id = ans.id LEFT JOIN fx_scored f ON f.id = ans.id""")
def q_trusted_override(spark, sf_dir):
    """Labels of the initial round, trusted rows replaced by the pseudo-label."""
    fb = _feedback(spark, sf_dir)
    return trusted_override(_initial(spark, sf_dir), fb.trusted, fb.pseudo).select("id", "label")


@register("q_need_annotation", SQL_OVERRIDE + """
SELECT doc_id AS id FROM documents EXCEPT SELECT id FROM top""")
def q_need_annotation(spark, sf_dir):
    """Corpus rows outside the trusted set (the only ones sent to the annotator)."""
    fb = _feedback(spark, sf_dir)
    return need_annotation(_corpus(spark, sf_dir).select("id"), fb.trusted)


SQL_ROUNDS = SQL_OVERRIDE + """,
rounds AS (
  SELECT 1 AS round, id, CASE WHEN anno < 0 THEN '' ELSE 'class' || CAST(anno AS VARCHAR) END AS raw, CAST(anno AS INTEGER) AS label FROM ans
  UNION ALL
  SELECT 2, r.id, CASE WHEN r.trusted THEN NULL WHEN maj.dlab IS NULL THEN '' ELSE 'class' || CAST(maj.dlab AS VARCHAR) END,
         r.label FROM refined r LEFT JOIN maj ON maj.id = r.id)"""


def _both_rounds(spark, sf_dir):
    r1 = _initial(spark, sf_dir).select(F.lit(1).alias("round"), "id", "raw", "label")
    root = scratch_dir(spark, "feedback")
    write_feedback(_feedback(spark, sf_dir), root, 1)
    r2 = refinery_round(_corpus(spark, sf_dir).select("id", "text"), read_feedback(spark, root, 1), TASK)
    return r1, r2.select(F.lit(2).alias("round"), "id", "raw", "label")


@register("q_union_batches", SQL_ROUNDS + """
SELECT CAST(round AS INTEGER) AS round, id, label FROM rounds""")
def q_union_batches(spark, sf_dir):
    """Per-round label outputs appended into one table (bag union)."""
    r1, r2 = _both_rounds(spark, sf_dir)
    return r1.unionByName(r2).select("round", "id", "label")


@register("q_annotation_log", SQL_ROUNDS + """
SELECT CAST(round AS INTEGER) AS round, id, raw FROM rounds WHERE raw IS NOT NULL""")
def q_annotation_log(spark, sf_dir):
    """Raw answers and sentences of both rounds in a log that the rounds write; the
    first round is run again and leaves it as it is."""
    log = AnnotationLog(spark, scratch_dir(spark, "annotation_log"))
    corpus, pool = _corpus(spark, sf_dir), _pool(spark, sf_dir)
    root = scratch_dir(spark, "feedback")
    write_feedback(_feedback(spark, sf_dir), root, 1)
    initial_round(corpus, pool, TASK, log=log, round_no=1)
    refinery_round(corpus.select("id", "text"), read_feedback(spark, root, 1), TASK, log=log, round_no=2)
    initial_round(corpus, pool, TASK, refuse, log=log, round_no=1)
    return log.read().select("round", "id", "raw")


@register("q_label_sink", SQL_INITIAL + """
SELECT id, CAST(anno AS INTEGER) AS label FROM ans""")
def q_label_sink(spark, sf_dir):
    """Labels written (Parquet, plus one-label-per-line text in id order) and read back."""
    path = scratch_dir(spark, "labels")
    write_labels(_initial(spark, sf_dir), path, text_export=path + "_txt")
    return spark.read.parquet(path)
