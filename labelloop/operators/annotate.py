"""Annotation: the pluggable annotator (X1), the built-in similarity vote (X1b),
retry and rate ceiling (X2), answer parsing (P15, F13, F14), trusted-row override (J5),
and the anti-join that keeps trusted rows away from the annotator (J5b)."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloop.functions.labels import parse_answer
from labelloop.operators.answers import AnswerStore
from labelloop.session import stored

ANNOTATOR_BATCH = 100   # prompts per remote call (reference batch size)
MAX_BROADCAST_KEYS = 200_000   # keys of prompts without an answer that may go to all tasks


def similarity_vote(labels_col: str = "demo_labels", sims_col: str = "sims") -> Column:
    """Label with the largest summed similarity among the retrieved demos;
    ties go to the smaller label. Pure higher-order functions over the per-row
    arrays, so it runs in the task that produced the neighbours (no shuffle)."""
    pairs = F.arrays_zip(F.col(labels_col).alias("l"), F.col(sims_col).alias("s"))
    scored = F.transform(
        F.array_distinct(F.col(labels_col)),
        lambda a: F.struct(
            F.aggregate(F.filter(pairs, lambda p: p["l"] == a), F.lit(0.0), lambda acc, p: acc + p["s"]).alias("score"),
            (-a).alias("neg")))
    best = F.array_max(scored)
    return F.when(F.size(F.col(labels_col)) > 0, -best["neg"])


def knn_vote(wide_knn: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, pred) from the wide kNN form."""
    return wide_knn.select(id_col, similarity_vote().cast("int").alias("pred"))


# ---------------------------------------------------------------------------
# Pluggable annotator over prompt message lists

Annotator = Callable[[Sequence[Sequence[dict]]], Sequence[str]]


def majority_answer_annotator(batch: Sequence[Sequence[dict]]) -> list[str]:
    """Offline default annotator: answers with the most frequent demonstration
    answer in the prompt (assistant turns); ties go to the answer of the
    earliest (most similar) demonstration. Deterministic, no network."""
    out = []
    for messages in batch:
        answers = [m["content"] for m in messages if m["role"] == "assistant"]
        if not answers:
            out.append("")
            continue
        counts: dict[str, int] = {}
        for a in answers:
            counts[a] = counts.get(a, 0) + 1
        top = max(counts.values())
        out.append(next(a for a in answers if counts[a] == top))
    return out


class Retryable(Exception):
    """A failed call that may work later: a rate limit, an overloaded service."""


RETRYABLE = (Retryable, ConnectionError, TimeoutError)


def with_retry(fn: Annotator, retries: int = 5, base_delay: float = 1.0,
               retry_on: tuple = RETRYABLE) -> Callable:
    """Exponential back-off around an annotator call. Errors in ``retry_on`` are
    tried again, any other one is final at once. Returns the answers and None, or
    no answers and the error."""
    def call(batch):
        delay = base_delay
        for attempt in range(retries + 1):
            try:
                return list(fn(batch)), None
            except retry_on as e:      # noqa: PERF203
                if attempt == retries:
                    return [None] * len(batch), e
                time.sleep(delay)
                delay *= 2
            except Exception as e:     # noqa: BLE001 - final: reported by the caller
                return [None] * len(batch), e
        raise ValueError("retries must not be negative")
    return call


class RateCeiling:
    """An annotator with at most ``calls`` calls in any ``seconds`` of a worker process (the
    ceiling a remote service sets for a key): a call over it is not made but fails as
    ``Retryable``, so that the back-off spaces the calls out."""

    def __init__(self, inner: Annotator, calls: int, seconds: float = 60.0):
        self.inner, self.calls, self.seconds, self.made = inner, calls, seconds, []

    def __call__(self, batch):
        now = time.monotonic()
        self.made = [t for t in self.made if now - t < self.seconds]
        if len(self.made) >= self.calls:
            raise Retryable(f"over {self.calls} calls in {self.seconds} s")
        self.made.append(now)
        return self.inner(batch)


def annotate(prompts: DataFrame, annotator: Annotator = majority_answer_annotator, *,
             id_col: str = "id", messages_col: str = "messages", batch_size: int = ANNOTATOR_BATCH,
             retries: int = 0, base_delay: float = 1.0, retry_on: tuple = RETRYABLE, on_error: str = "raise",
             store: AnswerStore | None = None, keep: tuple = ()) -> DataFrame:
    """Run ``annotator`` over the message lists, ``batch_size`` prompts
    per call, inside ``mapInArrow`` (the only place a network client may live).

    Returns ``(id, *keep, raw, error)``; ``raw`` is the answer text. The id travels with
    the row (J6), so no positional zip is needed. The annotator is costly and
    non-deterministic in general: with a ``store`` every answer is kept as soon as it
    is there, and neither a retried task nor a later run asks for it again. Without
    one, write the result before reusing it.

    A batch that still fails after ``retries``, or at once by an error that is not in
    ``retry_on``, fails the job; with ``on_error="keep"`` its rows stay apart
    instead: no answer, the error text, no label (see ``parse_labels``), and nothing
    in the store, so that the next run asks again.
    """
    if on_error not in ("raise", "keep"):
        raise ValueError(on_error)
    call = with_retry(annotator, retries=retries, base_delay=base_delay, retry_on=retry_on)
    paid = store.run() if store else None
    asked = F.sha2(F.to_json(messages_col), 256) if store else F.lit(None).cast("string")
    rows = prompts.select(F.col(id_col).cast("bigint").alias(id_col), *keep, messages_col, asked.alias("__prompt"))
    answered = store.read(prompts.sparkSession) if store else None
    done = None
    if answered is not None:
        # a prompt is a hundred times its answer: its key meets the answers, and only what has none is asked for
        answered = answered.select(F.col("id").alias(id_col), F.col("prompt").alias("__prompt"), "raw")
        keys = stored(rows.drop(messages_col), "prompt-keys")
        done = keys.join(answered, [id_col, "__prompt"]).select(id_col, *keep, "raw", F.lit(None).cast("string").alias("error"))
        missing = stored(keys.join(answered, [id_col, "__prompt"], "left_anti").select(F.col(id_col).alias("__id"), F.col("__prompt").alias("__of")).distinct(), "unanswered")
        n = missing.count()
        if not n:
            return done
        rows = rows.join(F.broadcast(missing) if n <= MAX_BROADCAST_KEYS else missing, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__prompt") == F.col("__of")), "left_semi")

    def run(batches):
        known = paid.known() if paid else {}
        for part in (b.slice(start, batch_size) for b in batches for start in range(0, b.num_rows, batch_size)):
            ids, hashes = part.column(id_col).to_pylist(), part.column("__prompt").to_pylist()
            answers = [known.get(key) for key in zip(ids, hashes, strict=True)]
            ask = [i for i, a in enumerate(answers) if a is None]
            err = None
            if ask:
                new, err = call(part.column(messages_col).take(pa.array(ask)).to_pylist())
                if err is None and len(new) != len(ask):
                    err = ValueError(f"{len(ask)} prompts, {len(new)} answers")
                if err is not None and on_error == "raise":
                    raise RuntimeError(f"annotator failed: {type(err).__name__}: {err}") from err
                if err is None:
                    for i, a in zip(ask, new, strict=True):
                        answers[i] = a
                    if paid:
                        paid.write([ids[i] for i in ask], [hashes[i] for i in ask], list(new))
            failed = set(ask) if err is not None else ()
            errors = [f"{type(err).__name__}: {err}" if i in failed else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (id_col, *keep)), pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                                             names=[id_col, *keep, "raw", "error"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in prompts.select(*keep).schema.fields) if keep else ""
    new = rows.mapInArrow(run, f"{id_col} bigint, {kept}raw string, error string")
    return new if done is None else done.unionByName(new)


def parse_labels(raw: DataFrame, words: Sequence[str], raw_col: str = "raw",
                 trim: bool = False) -> DataFrame:
    """F13/F14 on the annotator output: adds ``label`` (-1 when the answer is not a
    class word, NULL when the call failed and there is no answer)."""
    label = parse_answer(F.col(raw_col), words, trim=trim)
    if "error" in raw.columns:
        label = F.when(F.col("error").isNull(), label)
    return raw.withColumn("label", label)


def trusted_override(labels: DataFrame, trusted: DataFrame, pseudo: DataFrame,
                     id_col: str = "id") -> DataFrame:
    """Rows in the trusted set take the small model's pseudo-label."""
    t = trusted.select(F.col(id_col).alias("_tid")).distinct()
    p = pseudo.select(F.col(id_col).alias("_pid"), F.col("pred").alias("_pred"))
    j = (labels.join(t, labels[id_col] == t["_tid"], "left")
         .join(p, labels[id_col] == p["_pid"], "left"))
    return j.withColumn("label", F.when(F.col("_tid").isNotNull(), F.col("_pred")).otherwise(F.col("label"))) \
            .drop("_tid", "_pid", "_pred")


def need_annotation(rows: DataFrame, trusted: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that are not trusted, i.e. that really need the annotator."""
    return rows.join(trusted.select(id_col).distinct(), id_col, "left_anti")


def batch_number(id_col: str = "id", size: int = ANNOTATOR_BATCH) -> Column:
    """Batch of ``size`` consecutive dense ids."""
    return F.floor(F.col(id_col) / F.lit(size)).cast("bigint")


def completion_json(raw_col: str = "raw") -> Column:
    """Wrap an answer in the chat-completion response shape (for P15)."""
    msg = F.struct(F.struct(F.col(raw_col).alias("content")).alias("message"))
    return F.to_json(F.struct(F.array(msg).alias("choices")))
