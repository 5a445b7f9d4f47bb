"""Scoring (X4) and per-row loss.

The scorer is a linear softmax head ``logits = W x + b`` over fixed embeddings.
``W`` is C x d (C classes), so it is broadcast; each partition does one matrix
product in ``mapInArrow``. A head comes either from class means (the "centroid
head" fixture) or from the LogisticRegression fit of the self-training round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloop.functions import vectors as V
from labelloop.operators.retrieve import _list_matrix

MAX_HEAD_CELLS = 50_000_000     # C x d doubles that may be broadcast (400 MB)
ABSENT = -1e9                   # logit of a class without training rows: never the largest, probability 0


@dataclass
class LinearHead:
    weights: np.ndarray          # C x d
    bias: np.ndarray             # C

    @property
    def num_classes(self) -> int:
        return int(self.weights.shape[0])


def centroid_head(df: DataFrame, num_classes: int, label_col: str = "anno",
                  vec_col: str = "embedding") -> LinearHead:
    """Head whose class weight is the mean vector of the rows labelled with that
    class (valid labels only); absent classes can never win."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = (df.filter(F.col(label_col) >= 0)
             .groupBy(label_col)
             .agg(Summarizer.mean(array_to_vector(V.as_double(vec_col))).alias("m"))
             .select(F.col(label_col).cast("int").alias("c"), vector_to_array("m").alias("m")))
    d = df.agg(F.max(F.size(vec_col)).alias("d")).first()["d"] or 0
    if num_classes * d > MAX_HEAD_CELLS:
        raise ValueError("head too large to broadcast")
    w, b = np.zeros((num_classes, d)), np.full(num_classes, ABSENT)
    for r in means.collect():        # at most num_classes rows
        if 0 <= r["c"] < num_classes:
            w[r["c"]] = np.asarray(r["m"], dtype=np.float64)
            b[r["c"]] = 0.0
    return LinearHead(w, b)


def head_table(spark: SparkSession, head: LinearHead) -> DataFrame:
    """The head as a table, one row per class: cls, weights (the bias last)."""
    rows = [(c, [float(v) for v in w] + [float(b)]) for c, (w, b) in enumerate(zip(head.weights, head.bias, strict=True))]
    return spark.createDataFrame(rows, "cls int, weights array<double>")


def read_head(table: DataFrame) -> LinearHead:
    """The head of ``head_table`` (C rows, checked)."""
    rows = table.orderBy("cls").collect()
    if [r["cls"] for r in rows] != list(range(len(rows))):
        raise ValueError("a head has one row for each class")
    m = np.array([r["weights"] for r in rows], np.float64)
    return LinearHead(m[:, :-1].copy(), m[:, -1].copy())


def score(df: DataFrame, head: LinearHead, vec_col: str = "embedding",
          out_col: str = "logits") -> DataFrame:
    """Append ``logits ARRAY<DOUBLE>`` = W x + b to every row."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((head.weights, head.bias))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    vec_idx = df.columns.index(vec_col)
    c = head.num_classes

    def run(batches):
        w, b = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _list_matrix(batch.column(vec_idx), w.shape[1])
            z = np.einsum("ij,kj->ik", x, w, optimize=False) + b   # batch-shape independent
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * c, c, dtype=np.int32))
            logits = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [logits],
                                             names=list(batch.schema.names) + [out_col])

    return df.mapInArrow(run, schema)


def add_scores(scored: DataFrame, label_col: str = "anno", logits: str = "logits") -> DataFrame:
    """pred (A4 argmax), conf (A4 max raw logit), loss (F5; NULL if label < 0),
    valid (P5), matched (P6)."""
    lab = F.col(label_col)
    return (scored
            .withColumn("pred", V.argmax(logits))
            .withColumn("conf", V.row_max(logits))
            .withColumn("loss", V.cross_entropy(logits, lab))
            .withColumn("valid", lab.isNotNull() & (lab >= 0))
            .withColumn("matched", F.col("valid") & (F.col("pred") == lab)))


def loss_range(scored: DataFrame, loss: str = "loss", valid: str = "valid") -> tuple[float, float]:
    """A2: min and max loss over valid rows (one small aggregate)."""
    r = scored.filter(F.col(valid)).agg(F.min(loss).alias("lo"), F.max(loss).alias("hi")).first()
    return r["lo"], r["hi"]


def scaled_loss(scored: DataFrame, loss: str = "loss", valid: str = "valid") -> DataFrame:
    """min-max scaled loss over valid rows (quirk 11: constant loss -> 0)."""
    lo, hi = loss_range(scored, loss, valid)
    lo = 0.0 if lo is None else lo
    hi = lo if hi is None else hi
    return scored.withColumn("x", F.when(F.col(valid), V.minmax_scale(loss, F.lit(lo), F.lit(hi))))


def mean_loss(df: DataFrame, loss: str = "loss", where=None) -> DataFrame:
    """A5: mean cross-entropy over a subset; NULL when the subset is empty."""
    d = df if where is None else df.filter(where)
    return d.agg(F.avg(loss).alias("mean_loss"))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Keyed output must not repeat a key (one aggregate; raises otherwise)."""
    dup = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"duplicate {key} {dup[0][key]}")
    return df
