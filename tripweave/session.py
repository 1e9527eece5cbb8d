"""Session settings and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# One scratch root per application, named once so that all callers agree on it.
_ROOTS: dict[str, str] = {}

# The JVM never compiles methods above 8000 bytes of bytecode. Wide projections (harmonising 18 columns) exceed
# that when fused into one stage and then run interpreted; with this limit Spark splits them instead.
_JIT_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


# What a task reads of a table that it sorts: stored rides take up ten times as much in memory.
_SORTED_SPLITS = ("spark.sql.files.maxPartitionBytes", "16m")


# What a task reads of a shuffle whose rows or keys it holds.
_COUNTED_PARTS = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jit_sized_codegen(spark: SparkSession):
    """Apply the method size limit to the actions inside the block."""
    return _with_setting(spark, *_JIT_LIMIT)


def splits_to_sort(spark: SparkSession):
    """Read files in splits that a task can sort in memory, for the actions inside the block."""
    return _with_setting(spark, *_SORTED_SPLITS)


@contextmanager
def tasks_to_count(spark: SparkSession) -> Iterator[None]:
    """Read files and shuffles in parts whose keys a task can hold, for the actions inside the block: keys that hardly repeat take up a row each."""
    with _with_setting(spark, *_SORTED_SPLITS), _with_setting(spark, *_COUNTED_PARTS):
        yield


def build_session(
    app_name: str = "tripweave", master: str | None = None, shuffle_partitions: int | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session for tests, benchmarks and small runs; a cluster brings its own."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(*_JIT_LIMIT)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("TRIPWEAVE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Driver and executors in one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, unique to this application; it is deleted when the application's JVM ends.

    It lies under ``spark.checkpoint.dir``. Only on a local master, where driver and executors are one
    machine, is a fresh temporary folder used when that setting is absent; a cluster has to name one.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = base or tempfile.mkdtemp(prefix="tripweave-")
        root = f"{base.rstrip('/')}/tripweave-{app}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[app] = root
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
