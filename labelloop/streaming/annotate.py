"""Incremental labelling with Structured Streaming (ST1, ST2).

New corpus files land in a folder; each micro-batch runs the labelling round
on the rows it brings. ``foreachBatch`` is at-least-once, so every batch writes
to its own folder keyed by the batch id with ``overwrite``: a replayed batch
replaces its own output and every id is labelled exactly once. The file source
and the checkpoint guarantee that a file belongs to exactly one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloop.operators.annotate import annotate, majority_answer_annotator, parse_labels
from labelloop.operators.prompt import TaskSpec, prompts_from_wide
from labelloop.operators.retrieve import DEFAULT_BROADCAST_BYTES, PreparedPool, attach_demos
from labelloop.plans.rounds import Feedback, initial_round
from labelloop.session import stored


def _run(stream: DataFrame, handle, out_dir: str, checkpoint: str, processing_time: str | None = None) -> None:
    def batch(df: DataFrame, batch_id: int) -> None:
        handle(df).withColumn("batch_id", F.lit(batch_id)) \
                  .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    # availableNow: drain what has arrived and stop (batch-like runs, tests);
    # processing_time (e.g. "1 minute"): keep labelling files as they land
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    q.awaitTermination()


def stream_annotate(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint: str,
                    pool: DataFrame, task: TaskSpec,
                    annotator=majority_answer_annotator, max_files_per_trigger: int = 1,
                    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, **how) -> DataFrame:
    """ST1: (id, text, embedding) files -> labels, one folder per micro-batch.
    The pool (vectors, labels, texts) is made ready once for the whole stream: broadcast
    if it fits, else written in blocks that each micro-batch streams through."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    prepared = PreparedPool(pool, pool_label="anno", pool_text="text", max_broadcast_bytes=max_broadcast_bytes)
    try:
        _run(stream, lambda df: initial_round(df, prepared, task, annotator, **how).select("id", "raw", "label"),
             out_dir, checkpoint)
    finally:
        prepared.release()
    return spark.read.parquet(out_dir)


def stream_refine(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint: str,
                  fb: Feedback, corpus_text: DataFrame, task: TaskSpec,
                  annotator=majority_answer_annotator, max_files_per_trigger: int = 1, **how) -> DataFrame:
    """ST2: arriving rows joined to the feedback tables (trusted flag,
    pseudo-label, demo list); trusted rows keep the pseudo-label, the rest are
    annotated with the demonstrations of their feedback list.

    A batch first cuts the feedback tables down to its own ids (the id list of a
    batch is bounded by its files, so it can be broadcast), then joins what is
    left: its cost follows the batch, not the corpus. The batch is written once,
    since it is read by each of those steps."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    side = fb.pseudo.select("id", F.col("pred").cast("bigint").alias("label"))

    def of(table: DataFrame, ids: DataFrame) -> DataFrame:
        return table.join(ids, "id", "left_semi")

    def handle(df: DataFrame) -> DataFrame:
        df = stored(df, "refine-batch")
        ids = df.select("id").distinct()
        rows = (df.join(of(fb.trusted.select("id", F.lit(True).alias("trusted")), ids), "id", "left")
                .join(of(fb.pseudo.select("id", F.col("pred").alias("pseudo")), ids), "id", "left")
                .join(of(fb.demos, ids), "id", "left"))
        rows = stored(rows, "refine-rows")
        kept = rows.filter(F.col("trusted").isNotNull()).select(
            "id", F.lit(None).cast("string").alias("raw"), F.col("pseudo").cast("int").alias("label"))
        need = rows.filter(F.col("trusted").isNull()).select(
            "id", "text", F.coalesce("demo_ids", F.array().cast("array<bigint>")).alias("demo_ids"))
        named = need.select(F.explode("demo_ids").alias("id")).distinct()
        demos = of(side, named).join(of(corpus_text.select("id", "text"), named), "id", "left")
        prompts = prompts_from_wide(attach_demos(need, stored(demos, "demo-rows"), ("text", "label")), task)
        asked = parse_labels(annotate(prompts, annotator, **how), task.words)
        return asked.select("id", "raw", "label").unionByName(kept)

    _run(stream, handle, out_dir, checkpoint)
    return spark.read.parquet(out_dir)
