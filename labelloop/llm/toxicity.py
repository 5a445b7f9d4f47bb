"""Toxicity by a classifier chain (operator 8).

The categories form a chain. Each has a logistic model over the presence of words and of their
first letters (inflected and joined forms share a stem) and over the probabilities of the
categories before it. Earlier probabilities that a model is trained with are
out-of-fold predictions (``FOLDS`` folds by a hash of the id), those of scoring come from models
fitted to all training rows. The last category is the labelled one; the earlier ones have no labels
of their own here and are marked by the presence of a word of a short list.

Training uses at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of the id: a bound
on what the driver gathers, as sets of features); a feature enters a model if its presence differs
between the classes by ``MIN_Z`` standard errors, strongest first, ``MAX_WORDS`` of them at most.
Scoring reads every whole text once, without a shuffle.

Nulls: a null text is empty and has the probabilities of a text without any known word; label rows
with a null id or label are not used; repeated labels of an id count as toxic if one says so. With
no usable label row the last probability is null and nothing is toxic.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloop.llm.common import blocks, documents

TRAIN_ROWS, FOLDS = 4_000, 3
MIN_Z, MAX_WORDS, RIDGE = 5.0, 256, 0.1
STEMS = (4, 5, 6)
THRESHOLD = 0.5

# Weak marks of the categories without labels.
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("pathetic", "disgusting", "worthless", "trash", "stupid"),
}

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The words, and their first 4, 5 and 6 letters with a star."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the columns of ``x`` and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class WordRows:
    """Which feature occurs in which row."""

    def __init__(self, lists: pa.ChunkedArray):
        rows = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        words = rows.flatten().dictionary_encode()
        self.words = words.dictionary.to_pylist()
        self.word = words.indices.to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
        self.n = len(rows)

    def strongest(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Words whose presence differs most between the classes of the rows in use."""
        a, b = use[self.row] & (y[self.row] == 1), use[self.row] & (y[self.row] == 0)
        n1, n0 = max(1, int((use & (y == 1)).sum())), max(1, int((use & (y == 0)).sum()))
        c1, c0 = np.bincount(self.word[a], minlength=len(self.words)), np.bincount(self.word[b], minlength=len(self.words))
        rate = (c1 + c0) / (n1 + n0)
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
        best = np.lexsort((self.words, -z))[:MAX_WORDS] if len(self.words) else np.zeros(0, np.int64)
        return best[z[best] >= MIN_Z]

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        column = np.full(len(self.words) + 1, -1)
        column[chosen] = np.arange(len(chosen))
        at = column[self.word]
        x = np.zeros((self.n, len(chosen)))
        x[self.row[at >= 0], at[at >= 0]] = 1
        return x


def _fit(rows: WordRows, y: np.ndarray, use: np.ndarray, before: np.ndarray):
    chosen = rows.strongest(y, use)
    x = np.column_stack([rows.matrix(chosen), before])
    return chosen, _logistic(x[use], y[use]), x


def train_chain(rows: WordRows, marks: dict[str, np.ndarray], fold: np.ndarray) -> list[tuple[str, dict, np.ndarray, float]]:
    """(category, weight of each word, weights of the earlier probabilities, intercept) in order."""
    before, chain = np.zeros((rows.n, 0)), []
    everything = np.ones(rows.n, bool)
    for name, y in marks.items():
        chosen, w, _ = _fit(rows, y, everything, before)
        k = len(chosen)
        chain.append((name, {rows.words[c]: float(v) for c, v in zip(chosen, w[:k], strict=True)}, w[k:-1], float(w[-1])))
        held = np.zeros(rows.n)
        for f in range(FOLDS):
            out = fold == f
            if out.any() and not out.all():
                _, v, x = _fit(rows, y, ~out, before)
                held[out] = 1 / (1 + np.exp(-np.clip(x[out] @ v[:-1] + v[-1], -30, 30)))
        before = np.column_stack([before, held])
    return chain


def score(words: set[str], chain) -> list[float]:
    before: list[float] = []
    for _, weights, earlier, intercept in chain:
        z = intercept + sum(weights[w] for w in sorted(words & weights.keys())) + float(np.dot(earlier, before) if before else 0.0)
        before.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return before


def toxicity(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             categories: dict[str, tuple] = CATEGORIES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row: doc_id, a probability ``p_<category>`` for each category of the chain,
    the label's last, and ``toxic`` (its probability is ``THRESHOLD`` or more)."""
    docs = documents(df, id_col, text_col)
    sample = (labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y")).dropna()
              .groupBy("label_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows))
    gather = "doc_id long, y int, words array<string>"

    def sets(batches):
        for batch in batches:
            for block in blocks(batch):
                words = [sorted(features(t)) for t in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("y"), pa.array(words, pa.list_(pa.string()))], ["doc_id", "y", "words"])

    t = (docs.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")
         .mapInArrow(sets, gather).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")).toArrow().sort_by("doc_id"))
    names = [*categories, label_col]
    chain = []
    if t.num_rows:
        rows = WordRows(t.column("words"))
        known = {w: i for i, w in enumerate(rows.words)}
        marks = {}
        for name, listed in categories.items():
            y = np.zeros(rows.n, np.int64)
            y[rows.row[np.isin(rows.word, [known[w] for w in listed if w in known])]] = 1
            marks[name] = y
        marks[label_col] = (t.column("y").to_numpy() > 0).astype(np.int64)
        chain = train_chain(rows, marks, t.column("fold").to_numpy())

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                p = [score(features(x), chain) or [None] * len(names) for x in block.column("text").to_pylist()]
                cols = [pa.array(c, pa.float64()) for c in zip(*p, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *cols, pa.array([x[-1] is not None and x[-1] >= THRESHOLD for x in p])],
                                                 ["doc_id", *(f"p_{n}" for n in names), "toxic"])
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean")
