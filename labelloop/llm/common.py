"""Shared helpers of the operators: scratch tables, batches bounded in bytes."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloop.functions.batches import give_back
from labelloop.session import scratch_dir, ship_package

# Text handled at once inside a task; a single longer document is one block of its own.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """SQL settings (dots written as ``__``) for the jobs run inside the block."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later jobs neither repeat
    the work nor depend on the executors that did it. Shuffle files of the finished job go.
    Rows pass to Python in small batches, since texts are long."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
                  spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """Only the id, the text (null: empty) and ``more``, whatever other columns there are."""
    ship_package(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and where each row starts (n + 1 offsets)."""
    col = batch.column(column)
    sizes = pa.compute.binary_length(col).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[raw[0]:raw[-1]]
    return data, offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift, multiply): every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_HELD: dict = {}


def held(key, make):
    """What tasks of one operator share in a worker process; another operator's takes its place,
    so that a reused worker does not pile them up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def tidied(run):
    """``run`` for mapInArrow, leaving little behind in a worker process that waits for its next
    task: what another operator held goes first, and freed memory goes back at the end."""
    @functools.wraps(run)
    def wrapped(batches):
        if not getattr(run, "holds", False):
            _HELD.clear()
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def sql_crc32(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of the UTF-8 bytes of the string ``text``."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 * (i & 1)
        table.append(str(i))
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: CAST('0x' || x AS BIGINT))), "
            f"lambda c, b: xor(c >> 8, ([{', '.join(table)}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)")
