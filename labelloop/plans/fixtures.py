"""Deterministic derived tables over the driver's parquet fixtures.

No model is available offline, so the stand-ins are built from the given tables
(see FIXTURES.md): a noisy annotation of the ``embeddings`` labels, a linear
"centroid head" scorer, a bounded demonstration pool, a text corpus with labels,
and a text+vector corpus. Everything here is a DataFrame job over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUM_CLASSES = 10          # embeddings.label is 0..9
DEMOS_PER_CLASS = 10      # 100 demonstrations in total (reference default)
SHOTS = 10                # demonstrations per prompt (reference default)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, embedding ARRAY<DOUBLE>) from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def noisy_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_anno: (id, gold, anno, embedding). The noise rule stands in for an
    imperfect annotator: every 11th id is ambiguous (-1), every 7th is shifted
    to the next class."""
    v = vectors(spark, sf_dir)
    anno = (F.when(F.col("id") % 11 == 0, F.lit(-1))
            .when(F.col("id") % 7 == 0, (F.col("label") + 1) % NUM_CLASSES)
            .otherwise(F.col("label")))
    return v.select("id", F.col("label").alias("gold"), anno.cast("int").alias("anno"), "embedding")


def demo_pool(spark: SparkSession, sf_dir: str, per_class: int = DEMOS_PER_CLASS, base: DataFrame | None = None,
              ) -> DataFrame:
    """Bounded demonstration pool (demo_id, anno, embedding): per class the rows
    of ``base`` (default: all vectors) nearest to the class mean."""
    from labelloop.operators.retrieve import class_prototypes
    protos = class_prototypes(base if base is not None else vectors(spark, sf_dir), per_class)
    extra = ["text"] if "text" in protos.columns else []
    return protos.select(F.col("id").alias("demo_id"), F.col("label").alias("anno"), "embedding", *extra)


def text_demo_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool for the labelling rounds: drawn from the rows that have a text."""
    return demo_pool(spark, sf_dir, base=text_vectors(spark, sf_dir))


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_corpus: documents left join labels -> (id, text, label = quality)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"),
                                                 F.col("quality").cast("int").alias("label"))
    return docs.join(labs, "id", "left")


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of every document, for jobs that need no label."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_text_vec: every document, with its vector where ``embeddings`` has one
    (doc_id = vec_id) -> (id, text, label, embedding). A document without a vector
    has no neighbours and is labelled without demonstrations."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(vectors(spark, sf_dir), "id", "left")


# ---------------------------------------------------------------------------
# DuckDB forms of the same fixtures, used by the oracle SQL strings.

SQL_VECTORS = "e AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

SQL_ANNO = """fx_anno AS (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS gold,
         CAST(CASE WHEN vec_id % 11 = 0 THEN -1
                   WHEN vec_id % 7 = 0 THEN (label + 1) % 10
                   ELSE label END AS INTEGER) AS anno,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings)"""

SQL_VECTORS_TEXT = ("e AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS v "
                    "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")


def sql_pool(base: str) -> str:
    """Pool: per class the 10 rows of ``e`` nearest (L2) to the class mean, ties by id."""
    return base + """,
e_long AS (SELECT id, label, UNNEST(range(0, len(v))) AS pos, UNNEST(v) AS x FROM e),
e_mean AS (SELECT label, pos, avg(x) AS m FROM e_long GROUP BY label, pos),
e_dist AS (SELECT l.id, l.label, sqrt(sum((l.x - m.m) * (l.x - m.m))) AS dist
           FROM e_long l JOIN e_mean m ON l.label = m.label AND l.pos = m.pos GROUP BY l.id, l.label),
pool AS (SELECT p.id AS demo_id, p.label AS anno, e.v
         FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY dist, id) AS rn FROM e_dist) p
         JOIN e ON e.id = p.id WHERE p.rn <= 10)"""


def sql_knn(base: str) -> str:
    """Top-10 pool rows per row of ``e`` by cosine, ties by demo id."""
    return sql_pool(base) + """,
sims AS (SELECT e.id, pool.demo_id, pool.anno, list_cosine_similarity(e.v, pool.v) AS sim FROM e, pool),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, demo_id) AS rank FROM sims)
        WHERE rank <= 10)"""


SQL_POOL = sql_pool(SQL_VECTORS)
SQL_KNN = sql_knn(SQL_VECTORS)
SQL_KNN_TEXT = sql_knn(SQL_VECTORS_TEXT)

SQL_CORPUS = """fx_corpus AS (
  SELECT d.doc_id AS id, d.text, CAST(l.quality AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_scored: fx_anno scored by the centroid head ->
    (id, gold, anno, embedding, logits, pred, conf, loss, valid, matched)."""
    from labelloop.operators.score import add_scores, centroid_head, score
    anno = noisy_annotation(spark, sf_dir)
    head = centroid_head(anno, NUM_CLASSES, label_col="anno")
    return add_scores(score(anno, head), label_col="anno")


def view2(col: str = "embedding") -> F.Column:
    """fx_view2: a second view of a vector, element i = 0.9 v[i] + 0.1 v[d-1-i]."""
    return F.zip_with(F.col(col), F.reverse(F.col(col)), lambda a, b: a * 0.9 + b * 0.1)


SQL_SCORED = SQL_ANNO + """,
fx_long AS (SELECT id, anno, UNNEST(range(0, len(v))) AS pos, UNNEST(v) AS x FROM fx_anno),
fx_centroid AS (SELECT anno AS cls, pos, avg(x) AS m FROM fx_long WHERE anno >= 0 GROUP BY anno, pos),
fx_logit AS (SELECT l.id, c.cls, sum(l.x * c.m) AS z FROM fx_long l JOIN fx_centroid c ON l.pos = c.pos
             GROUP BY l.id, c.cls),
fx_mx AS (SELECT id, max(z) AS conf, ln(sum(exp(z))) AS lse, list(z ORDER BY cls) AS logits
          FROM fx_logit GROUP BY id),
fx_am AS (SELECT g.id, min(g.cls) AS pred FROM fx_logit g JOIN fx_mx ON g.id = fx_mx.id AND g.z = fx_mx.conf
          GROUP BY g.id),
fx_scored AS (
  SELECT a.id, a.gold, a.anno, a.v, fx_mx.logits, CAST(fx_am.pred AS INTEGER) AS pred, fx_mx.conf,
         CASE WHEN a.anno >= 0 THEN fx_mx.lse - g.z END AS loss,
         a.anno >= 0 AS valid, a.anno >= 0 AND fx_am.pred = a.anno AS matched
  FROM fx_anno a JOIN fx_mx ON a.id = fx_mx.id JOIN fx_am ON a.id = fx_am.id
  LEFT JOIN fx_logit g ON g.id = a.id AND g.cls = a.anno)"""


# The six answer shapes the parser must handle (plain word,
# capitalised with one dot, two dots, leading space, empty, unknown word).
STUB_ANSWERS = ("positive", "Negative.", "POSITIVE..", " negative", "", "neutral")


def length_annotator(batch) -> list[str]:
    """Stand-in for a remote model whose answers have every shape: one of ``STUB_ANSWERS`` by the length
    of the query sentence (the second-to-last message) modulo 6."""
    return [STUB_ANSWERS[len(msgs[-2]["content"]) % len(STUB_ANSWERS)] for msgs in batch]
