"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Every stage works on all rows that the one before it kept. Rows are matched by doc_id, null ids with
each other: rows that share an id share the verdict of a filtering stage (they stay if one of them
is kept by the classifier, they go if one of them is contaminated), and one row of an id stays
after near-dedup, that of the least hash of its text, then of all its columns, so a task that runs
again keeps the same one; rows with a null id are no near-duplicates of anything. Near-duplicates
with equal fingerprints are a tie that the smallest id wins. Empty tables give empty stages, and
without trusted labels the classifier keeps every text with a byte.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloop.llm.bpe import bpe_decode, bpe_encode
from labelloop.llm.common import stored, table, unused
from labelloop.llm.decontaminate import decontaminate
from labelloop.llm.kneser_ney import quality_scores
from labelloop.llm.simhash import simhash_dedup
from labelloop.llm.suffix_dedup import without_duplicates

# SQL has no merges, components or smoothed models; tests compare run() with a chain of brute-force
# stages.
ORACLE_SQL = None

MAX_BROADCAST_IDS = 1_000_000   # ids of removed documents that may be sent to every task (8 MB)


def _matched(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    key = unused(docs, "matched_id")
    keys = ids.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), how)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those of ``ids``. The ids are written and counted: within the bound they go to all
    tasks and the texts stay where they are, beyond it both sides are shuffled; the rows are the same."""
    key = unused(docs, "removed_id")
    keys = stored(ids.select(F.col("doc_id").alias(key)).distinct(), "removed")
    if keys.count() <= MAX_BROADCAST_IDS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    kept = _without(docs, simhash_dedup(docs).filter("component_id <> doc_id"))
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept
    order = F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
    one = _matched(kept, repeated, "left_semi").groupBy(F.col("doc_id").alias("of_id")).agg(F.min_by(F.struct(*docs.columns), order).alias("kept"))
    return _matched(kept, repeated, "left_anti").union(one.select("kept.*"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document with a smaller id already has."""
    out = without_duplicates(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of the decoded bytes.
    The ids are written in between: two Python functions in one stage are two workers for each core."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    x = bpe_decode(stored(bpe_encode(docs, path, public_tokenizers.PATTERN), "ids"), path)
    return x.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
