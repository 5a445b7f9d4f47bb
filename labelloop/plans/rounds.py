"""End-to-end jobs: labelling rounds (L1, L2), feedback emission (L4, L5) and
the label / feedback sinks (S9, S10, S11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloop.operators.annotate import (Annotator, annotate, majority_answer_annotator,
                                          need_annotation, parse_labels)
from labelloop.operators.answers import AnnotationLog
from labelloop.operators.demos import demo_lists, kmeans_clusters, representatives
from labelloop.operators.prompt import TaskSpec, prompts_from_wide
from labelloop.operators.retrieve import attach_demos, knn_topk
from labelloop.operators.select import top_fraction
from labelloop.session import stored

DEFAULT_SHOTS = 10
DEFAULT_DEMOS = 100


def round_prompts(corpus: DataFrame, pool: DataFrame, task: TaskSpec, *, shots: int = DEFAULT_SHOTS,
                  exclude_self: bool = False, id_col: str = "id") -> DataFrame:
    """(id, messages) of the initial round. pool: (demo_id, anno, embedding, text).

    Retrieval emits each row's demo texts and labels next to the row, and the
    prompt is a projection. A row without a vector, or an empty pool, gives a
    prompt without demonstrations."""
    from labelloop.operators.retrieve import PreparedPool
    if isinstance(pool, PreparedPool):
        wide = knn_topk(corpus.select(id_col, "embedding", "text"), pool, shots, query_id=id_col,
                        exclude_self=exclude_self, wide=True, keep=("text",))
    else:
        wide = knn_topk(corpus.select(id_col, "embedding", "text"), pool, shots, query_id=id_col,
                        pool_label="anno", exclude_self=exclude_self, wide=True, keep=("text",),
                        pool_text="text")
    return prompts_from_wide(wide, task, id_col=id_col)


def _asked(prompts: DataFrame, annotator: Annotator, task: TaskSpec, id_col: str, log: AnnotationLog | None, round_no: int, **how) -> DataFrame:
    """(id, raw, error, label) of the prompts; with a log they are the rows of the round in it."""
    if log is None:
        return parse_labels(annotate(prompts, annotator, id_col=id_col, **how), task.words)
    sentence = F.element_at("messages", -2)["content"].alias("sentence")
    rows = log.append(round_no, lambda: parse_labels(annotate(prompts.select(id_col, "messages", sentence), annotator, id_col=id_col, keep=("sentence",), **how), task.words))
    return rows.select(id_col, "raw", "error", "label")


def initial_round(corpus: DataFrame, pool: DataFrame, task: TaskSpec,
                  annotator: Annotator = majority_answer_annotator, *, shots: int = DEFAULT_SHOTS,
                  exclude_self: bool = False, id_col: str = "id", log: AnnotationLog | None = None, round_no: int = 0, **how) -> DataFrame:
    """L1: retrieve the ``shots`` most similar demonstrations from the pool for
    every corpus row, build the few-shot prompt, annotate, parse.

    corpus: (id, text, embedding); pool: (demo_id, anno, embedding, text), small
    by design. Every corpus row gets a label. Returns (id, raw, error, label). With
    ``log`` the sentences and answers are its rows for ``round_no``, written once: a
    round that is in the log is not run again. ``how``: as in ``annotate`` (retries,
    base_delay, retry_on, on_error, store)."""
    prompts = round_prompts(corpus, pool, task, shots=shots, exclude_self=exclude_self, id_col=id_col)
    return _asked(prompts, annotator, task, id_col, log, round_no, **how)


@dataclass
class Feedback:
    trusted: DataFrame    # (id)
    demos: DataFrame      # (id, demo_ids ARRAY<BIGINT>)
    pseudo: DataFrame     # (id, pred INT)


def emit_feedback(scored: DataFrame, num_classes: int, *, select_demo_num: int = DEFAULT_DEMOS,
                  shot_num: int = DEFAULT_SHOTS, rho: float = 0.2, clusterer=kmeans_clusters,
                  id_col: str = "id") -> Feedback:
    """L4 + L5: trusted set (per-class top fraction of matched rows), one demo
    list per row (per class the nearest cluster representatives, classes
    concatenated), and the pseudo-label of every row (quirk 14: rows with an
    invalid label get them too). Without a trusted row every demo list is empty.
    The scored rows are written once; every step reads that table."""
    scored = stored(scored.select(id_col, "pred", "conf", "matched", "embedding"), "scored")
    top = stored(top_fraction(scored, rho=rho), "trusted")
    if top.isEmpty():
        none = scored.select(id_col, F.array().cast("array<bigint>").alias("demo_ids"))
        return Feedback(top.select(id_col), none, scored.select(id_col, "pred"))
    trusted = top.select(id_col)
    chosen = scored.join(top.select(id_col), id_col).select(id_col, "pred", "embedding")
    reps = representatives(chosen, select_demo_num // num_classes, clusterer, cls="pred")
    lists = demo_lists(scored.select(id_col, "pred", "embedding"), reps, shot_num // num_classes)
    return Feedback(trusted, lists.select(id_col, "demo_ids"), scored.select(id_col, "pred"))


def write_feedback(fb: Feedback, root: str, round_no: int) -> None:
    """The three feedback tables, one folder per round; a round written again
    replaces itself and no other round."""
    for name, df in (("trusted", fb.trusted), ("demos", fb.demos), ("pseudo", fb.pseudo)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/round={round_no}")


def read_feedback(spark: SparkSession, root: str, round_no: int) -> Feedback:
    """Read one round back (only its folder)."""
    def rd(name):
        return spark.read.parquet(f"{root}/{name}/round={round_no}")
    return Feedback(rd("trusted"), rd("demos"), rd("pseudo"))


def refinery_round(corpus: DataFrame, fb: Feedback, task: TaskSpec,
                   annotator: Annotator = majority_answer_annotator, *, id_col: str = "id",
                   log: AnnotationLog | None = None, round_no: int = 0, **how) -> DataFrame:
    """L2: rows of the trusted set keep the small model's pseudo-label (J5); only
    the other rows are sent to the annotator (J5b), with demonstrations fetched
    by the feedback lists (J3) and answered with the demos' pseudo-labels (J4).
    Returns (id, raw, error, label) for every corpus row; ``log`` and ``how`` as in
    ``initial_round`` (the log has the rows that were asked).

    The lists name about 100 representatives: the named ids come first, and the
    corpus and the pseudo-labels are cut down to them before texts and labels meet."""
    need = need_annotation(corpus.select(id_col, "text"), fb.trusted, id_col)
    rows = need.join(fb.demos, id_col, "left").withColumn(
        "demo_ids", F.coalesce("demo_ids", F.array().cast("array<bigint>")))
    named = stored(fb.demos.select(F.explode("demo_ids").alias(id_col)).distinct(), "named")
    side = (fb.pseudo.select(id_col, F.col("pred").cast("bigint").alias("label")).join(named, id_col, "left_semi")
            .join(corpus.select(id_col, "text").join(named, id_col, "left_semi"), id_col, "left"))
    prompts = prompts_from_wide(attach_demos(rows, stored(side, "demo-rows"), ("text", "label"), id_col=id_col), task, id_col=id_col)
    asked = _asked(prompts, annotator, task, id_col, log, round_no, **how)
    kept = (corpus.select(id_col).join(fb.trusted, id_col).join(fb.pseudo, id_col)
            .select(id_col, F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("error"),
                    F.col("pred").cast("int").alias("label")))
    return asked.unionByName(kept)


def write_labels(labels: DataFrame, path: str, text_export: str | None = None) -> None:
    """One label per id (overwrite). The optional text export writes one
    label per line in id order (range-partitioned, sorted within partitions;
    part files in order)."""
    labels.select("id", "label").write.mode("overwrite").parquet(path)
    if text_export:
        # read the written table back: the annotator behind ``labels`` must not
        # run a second time for the export
        written = labels.sparkSession.read.parquet(path)
        (written.select("id", F.col("label").cast("string").alias("value"))
         .repartitionByRange("id").sortWithinPartitions("id").select("value")
         .write.mode("overwrite").text(text_export))


def merge_labels(table: DataFrame, labels: DataFrame, out: str = "round_label", id_col: str = "id") -> DataFrame:
    """The labels of a round as a column of the training table. Every row must
    have exactly one label: other counts raise instead of losing rows."""
    marked = (table.withColumn("__row", F.lit(True)).join(labels.select(id_col, F.col("label").alias(out), F.lit(True).alias("__label")), id_col, "full"))
    marked = stored(marked, "merged")
    c = marked.agg(F.count(F.lit(1)), F.count_if(F.col("__label").isNull()), F.count_if(F.col("__row").isNull())).first()
    n = table.count()
    if c[1] or c[2] or c[0] != n:
        raise ValueError(f"{n} rows, {c[1]} rows without a label, {c[2]} labels without a row, {c[0]} rows with both")
    return marked.drop("__row", "__label")
