"""Runs of repeated words, found by multi-scale minimizers (operator 13).

A run is a stretch of words with smallest period q (words q apart are equal), at least
``max(6, 4 q)`` words long, that no neighbouring word extends. Periods up to ``SHORT`` are found by
comparing the words with those q places on, for each q.

Scale s = 16, 32, ... finds periods over s/2 up to s. Hashes of s words are built from those of s/2
words, and each window of s/2 such hashes marks its least one (the first of equals). A window
covers 1.5 s - 1 words, so a run of four periods holds one together with its copy one period on,
which marks the same hash there. A run's s words are at least one period, so they come again after
exactly one period and not before: neighbouring marks of equal hashes are one period apart. Each
such pair is extended to both sides by comparing words, which also sets aside chance hits, and kept
if its period is the smallest. Marks and pairs are fewer the larger the scale, so a text of n words
takes about n log n steps, and no more than its own words and hashes are held.

Nulls: a null text has no words; so has an empty one. Every row gives one row, null and repeated ids
and repeated rows included. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelloop.llm.common import documents, mixed, tidied

LEAST, TIMES = 6, 4
SHORT = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def _least(period: int) -> int:
    return max(LEAST, TIMES * period)


def _smaller(x: np.ndarray, start: int, period: int) -> bool:
    """Whether two periods of the run repeat more often: then by a part of the period."""
    y = x[start:start + 2 * period]
    return any(period % q == 0 and np.array_equal(y[q:], y[:-q]) for q in range(1, period // 2 + 1))


def _short(x: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, min(SHORT, len(x) // TIMES) + 1):
        same = np.zeros(len(x) - q + 2, np.int8)
        same[1:-1] = x[q:] == x[:-q]
        step = np.diff(same)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = ends - starts + q >= _least(q)
        found += [(int(a), int(b - a) + q, q) for a, b in zip(starts[long], ends[long], strict=True) if not _smaller(x, a, q)]
    return found


def _marks(h: np.ndarray, width: int) -> np.ndarray:
    """Places that are the first least of some window of ``width`` (a power of two) hashes."""
    value, place, w = h, np.arange(len(h)), 1
    while w < width:
        right = value[w:] < value[:-w]
        place = np.where(right, place[w:], place[:-w])
        value = np.where(right, value[w:], value[:-w])
        w *= 2
    return place[np.append(True, place[1:] != place[:-1])]


def _reach(x: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal those one period later."""
    n, size = 0, 64
    while True:
        if step > 0:
            a = x[at + n:at + n + size]
            b = x[at + n + period:at + n + period + size]
            a = a[:len(b)]
        else:
            end = at - n + 1
            a = x[max(0, end - size):max(0, end)][::-1]
            b = x[max(0, end - size) + period:max(0, end) + period][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 2


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    x = numbers(words)
    found = _short(x)
    h, k, scale = mixed(x.astype(np.uint64) * _STEP + _STEP), 1, 2 * SHORT
    while TIMES * (scale // 2 + 1) <= len(x):
        while k < scale:
            h = mixed(h[:-k] * _STEP + h[k:])
            k *= 2
        marks = _marks(h, scale // 2)
        marks = marks[np.argsort(h[marks], kind="stable")]
        period = marks[1:] - marks[:-1]
        pairs = np.flatnonzero((h[marks[1:]] == h[marks[:-1]]) & (period > scale // 2) & (period <= scale))
        seen: dict[int, int] = {}  # where the last stretch of a period ends
        for at, q in sorted(zip(marks[:-1][pairs].tolist(), period[pairs].tolist(), strict=True)):
            if at < seen.get(q, 0):
                continue
            end = at + _reach(x, at, q, 1)
            start = at - _reach(x, at - 1, q, -1) if end > at else at
            seen[q] = end
            if end - start + q >= _least(q) and not _smaller(x, start, q):
                found.append((start, end - start + q, q))
        scale *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return words if not found else [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_words, runs (start, length, period, in words, by
    start and period), collapsed (the words that stay, joined by one space)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            n, found, texts = [], [], []
            for t in batch.column("text"):
                words = t.as_py().encode().split()  # bytes: ASCII white space only
                r = runs(words)
                n.append(len(words)), found.append([{"start": a, "length": b, "period": c} for a, b, c in r])
                texts.append(b" ".join(collapsed(words, r)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])
    return documents(df, id_col, text_col).mapInArrow(tidied(run), "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
