"""Steps that are done once: data first, then a small record that points at it.

A step writes its rows to a folder of its own attempt and is committed by one row
of the ``commits`` table under the same root. Readers go by the record only, so a
step that was killed half way is as if it had never run, its folder is never read,
and a job that starts again goes on after its last committed step. Of two attempts
that both end, the one recorded first counts and both return its rows.

Only Spark's readers and writers touch the storage, so the root can be any store
that Spark reaches.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "step string, path string, at bigint"


def read_if_there(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is no such folder."""
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Commits:
    """The committed steps under ``root``. Their number is that of the job's steps."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def steps(self, latest: bool = False) -> dict[str, str]:
        """step -> folder, in the order of commits; of several records of a step the first
        one counts (``latest``: the last one)."""
        records = read_if_there(self.spark, f"{self.root}/commits", _RECORD)
        out: dict[str, str] = {}
        for r in records.orderBy("at", "path").collect() if records is not None else []:
            if latest or r["step"] not in out:
                out[r["step"]] = r["path"]
        return out

    def attempt(self, step: str) -> str:
        """A fresh folder for the data of a step."""
        return f"{self.root}/{re.sub('[^A-Za-z0-9=._-]+', '-', step)}-{uuid.uuid4().hex[:12]}"

    def commit(self, step: str, path: str) -> None:
        self.spark.createDataFrame([(step, path, time.time_ns())], _RECORD).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def table(self, step: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
        """The rows of ``step``; ``make`` runs if no attempt is committed (``again``: in any case)."""
        path = None if again else self.steps().get(step)
        if path is None:
            path = self.attempt(step)
            make().write.parquet(path)
            self.commit(step, path)
            path = self.steps(latest=again)[step]
        return self.spark.read.parquet(path)


def fingerprint(df: DataFrame) -> str:
    """What a table's files look like now: number, names, sizes and times of the files that
    ``df`` reads, and its schema. No file is opened; sums do not depend on their order."""
    spark, files = df.sparkSession, df.inputFiles()
    schema = df.schema.json()
    if not files:
        seen = (0, 0)
    else:
        f = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        seen = f.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{spark.range(1).select(F.sha2(F.lit(f'{schema} {seen[0]} {seen[1]}'), 256)).first()[0][:32]}"
