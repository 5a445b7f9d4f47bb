"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from labelloop.llm.bpe import bpe_decode, bpe_encode, token_counts
from labelloop.llm.common import table
from labelloop.llm.decontaminate import DECONTAMINATE_SQL, decontaminate
from labelloop.llm.html_extract import extract_main_text
from labelloop.llm.kneser_ney import quality_scores
from labelloop.llm.language_id import identify_languages
from labelloop.llm.merkle import MERKLE_SQL, merkle_manifest
from labelloop.llm.periodic import periodic_runs
from labelloop.llm.quality_rules import QUALITY_SQL, quality_rules
from labelloop.llm.sharding import SHARDING_SQL, shard_documents
from labelloop.llm.simhash import simhash_dedup
from labelloop.llm.suffix_dedup import suffix_dedup
from labelloop.llm.toxicity import toxicity

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query
def op5_simhash_dedup(spark, sf_dir):
    return simhash_dedup(table(spark, sf_dir, "documents"))


@query
def op3_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    x = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return x.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 512)


@query
def op10_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


ORACLES["op10_quality_rules"] = QUALITY_SQL


@query
def op9_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op9_decontamination"] = DECONTAMINATE_SQL


@query
def op2_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op1_language_id(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op11_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), 8)


ORACLES["op11_sharding"] = SHARDING_SQL


def _crc32_of_id():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@query
def op12_merkle_manifest(spark, sf_dir):
    tampered = F.when(_crc32_of_id() % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle_manifest(table(spark, sf_dir, "documents"), {"n_chars": tampered}).drop("n_copied", "proof")


ORACLES["op12_merkle_manifest"] = MERKLE_SQL


def planted_runs(docs):
    """``docs`` where every tenth id, by its checksum, repeats its own words from word a on, p words apart."""
    words = F.coalesce(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.array().cast("array<string>"))
    x = docs.withColumn("h", _crc32_of_id()).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    x = (x.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % greatest(n, 1)"))
         .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    again = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> element_at(words, cast(if(i < a, i, a + (i - a) % p) as int) + 1)))")
    return x.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    x = periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    x = x.withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"))
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-best.start").alias("start"), F.col("best.length").alias("length"),
                    F.expr("-best.period").alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
