"""Catalogue: streaming labelling (ST1, ST2). Each query lands the corpus as
several files, runs the stream to completion (availableNow) and returns the
labels, which must equal the batch rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloop.operators.demos import fixed_clusters
from labelloop.plans import fixtures as fx
from labelloop.plans.q_labelling import SQL_INITIAL, SQL_REFINE, TASK, _corpus
from labelloop.plans.registry import register
from labelloop.plans.rounds import emit_feedback, read_feedback, write_feedback
from labelloop.session import scratch_dir
from labelloop.streaming.annotate import stream_annotate, stream_refine

N_FILES = 4


def _land(spark, sf_dir):
    """Write the corpus as N_FILES parquet files (the arriving files)."""
    src = scratch_dir(spark, "landing")
    corpus = _corpus(spark, sf_dir).select("id", "text", "embedding")
    corpus.repartitionByRange(N_FILES, "id").write.mode("overwrite").parquet(src)
    return src, corpus.schema


@register("q_stream_annotate", SQL_INITIAL + """
SELECT id, CAST(anno AS INTEGER) AS label FROM ans""")
def q_stream_annotate(spark, sf_dir):
    """ST1: incremental initial round, one file per micro-batch; equals the batch result."""
    src, schema = _land(spark, sf_dir)
    out = stream_annotate(spark, src, schema, scratch_dir(spark, "stream_out"), scratch_dir(spark, "stream_ckpt"),
                          fx.text_demo_pool(spark, sf_dir), TASK)
    return out.select("id", "label")


@register("q_stream_refine", SQL_REFINE + """
SELECT id, label FROM refined""")
def q_stream_refine(spark, sf_dir):
    """ST2: incremental refinery round with a stream-static join to the feedback."""
    src, schema = _land(spark, sf_dir)
    root = scratch_dir(spark, "feedback")
    write_feedback(emit_feedback(fx.scored(spark, sf_dir), fx.NUM_CLASSES, clusterer=fixed_clusters), root, 1)
    fb = read_feedback(spark, root, 1)
    corpus_text = _corpus(spark, sf_dir).select("id", "text")
    out = stream_refine(spark, src, schema, scratch_dir(spark, "stream_out"), scratch_dir(spark, "stream_ckpt"),
                        fb, corpus_text, TASK)
    return out.select("id", F.col("label").cast("int").alias("label"))
