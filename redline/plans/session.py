"""Session construction and lineage cutting.

Jobs never pick a machine-local folder on a cluster: the shared folder named by
``spark.checkpoint.dir`` is read from the session. Only a local-mode session
(tests, the bench) without that setting gets a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "redline") -> SparkSession:
    """Session with AQE (coalescing + skew join) and Arrow on, UI off."""
    master = master or os.environ.get("REDLINE_MASTER")
    memory = os.environ.get("REDLINE_DRIVER_MEMORY")
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:                       # else what spark-submit or the Spark settings name
        builder = builder.master(master)
    if memory or (master or "").startswith("local"):
        builder = builder.config("spark.driver.memory", memory or "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``redline`` importable in the Python workers (what ``--py-files``
    does): the package is zipped once per SparkContext and added with
    ``addPyFile``, so UDFs and ``mapInPandas`` functions resolve on executors
    whatever their working directory."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="redline-pyfiles-"), "redline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if not sc.master.startswith("local"):
        # on a cluster the executors fetch the zip from the shared folder
        out = stage_shared(spark, out, f"{key}-redline.zip")
    sc.addPyFile(out)
    _SHIPPED.add(key)


def stage_shared(spark: SparkSession, local_file: str, name: str) -> str:
    """Copy a driver-side file into the shared checkpoint folder (Hadoop
    FileSystem API) and return its shared path."""
    sc = spark.sparkContext
    shared = f"{checkpoint_dir(spark).rstrip('/')}/pyfiles/{name}"
    jvm, hconf = sc._jvm, sc._jsc.hadoopConfiguration()
    dst = jvm.org.apache.hadoop.fs.Path(shared)
    dst.getFileSystem(hconf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local_file), dst)
    return shared


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a shared folder: lineage is cut there")
        configured = tempfile.mkdtemp(prefix="redline-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "table", partition_by=()) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back (never localCheckpoint). One computation, one write; the
    stored table survives executor loss, and the read carries file statistics
    for AQE and broadcast decisions."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.mode("error").partitionBy(*partition_by).parquet(path)
    record_path(spark, path)
    return spark.read.schema(df.schema).parquet(path)      # a partitioned empty table has no file to read it from


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` has ``value`` for what is planned inside, then what it had before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """Spark deletes the shuffle files of what is written inside as soon as it is
    written: they are read no more, and its own cleaner waits for a garbage collection."""
    return setting(spark, CLEANUP_CONF, "true")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder that ``drop_tables`` removes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    record_path(spark, path)
    return path


def record_path(spark: SparkSession, path: str) -> None:
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


_WRITTEN: dict = {}


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables this application wrote with ``cut_lineage`` (through
    the Hadoop FileSystem API, so shared storage works too). Call it once the
    results that read them are written; returns the number removed."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        jp = jvm.org.apache.hadoop.fs.Path(p)
        jp.getFileSystem(hconf).delete(jp, True)
    return len(paths)
