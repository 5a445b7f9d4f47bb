"""Session construction and shared-storage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Configuration the library relies on. On a cluster these come from the
# deployment; get_spark() only fills them in for local runs and tests.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one remote-annotator call per 100 prompts (reference batch size)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "labelloop", extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("LABELLOOP_DRIVER_MEMORY", "16g")
    conf.update(extra_conf or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to shared storage; a machine-local folder
    would lose data there, so an unset value raises. Only on a local master
    (tests, the bench) do we pick a private folder, and we record it in the
    session so every later call agrees.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="labelloop-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for a stage table."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, spark: SparkSession | None = None):
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage."""
    spark = spark or df.sparkSession
    checkpoint_root(spark)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write ``df`` to the shared scratch folder and read it back: every later use
    reads the table instead of running the plan again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """At most ``most`` rows pass to Python at once in the jobs that run inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(old)) if int(old) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def ensure_parallelism(df, factor: int = 1):
    """Spread a scan that yields fewer partitions than the cluster has cores
    (one large row group, a single small file) over all cores before per-row
    heavy work. A scan that is already wide is returned untouched, so at scale
    this adds no shuffle."""
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


_SHIPPED: set = set()
_ZIP: list = []


def ship_package(spark: SparkSession) -> None:
    """Make ``labelloop`` importable in the Python workers (functions shipped to
    executors are pickled by module reference): zip the package once per
    process and ``addPyFile`` it once per SparkContext."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if not _ZIP:
        import shutil
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp(prefix="labelloop-pkg-")
        _ZIP.append(shutil.make_archive(os.path.join(out, "labelloop"), "zip",
                                        root_dir=os.path.dirname(pkg_dir), base_dir="labelloop"))
    sc.addPyFile(_ZIP[0])
    _SHIPPED.add(key)
