"""Arrow batches cut by bytes: a batch has up to 10,000 rows, and texts and prompts are long. Freed memory
of a Python worker goes back to the machine when its task ends."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TEXT_BYTES = 1 << 20      # of texts worked on at once; a longer row is a slice of its own
OUT_BYTES = 4 << 20       # of rows given back at once
ROWS = 1000               # of an Arrow batch of whole texts, where a step sets it


def small(batch: pa.RecordBatch, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, of at most ``limit`` bytes (one row at least)."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
        return
    half = batch.num_rows // 2
    yield from small(batch.slice(0, half), limit)
    yield from small(batch.slice(half), limit)


def runs(sizes: np.ndarray, limit: int = OUT_BYTES) -> Iterator[slice]:
    """Runs of rows whose ``sizes`` add up to at most ``limit`` (one row at least)."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, stop)
        at = stop


def give_back() -> None:
    """Return freed memory of this process to the machine: Arrow's buffers, and the heap where the
    C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` for mapInArrow or applyInArrow; a worker process that waits for its next task holds
    little of the last one."""
    @functools.wraps(run)
    def rows(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return rows
