"""Session helpers: a tuned local session and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def local_session(app: str = "dwellframe", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # Long generated methods would otherwise stay interpreted (JVM limit of 8000 bytecodes).
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="dwellframe-")
    return _LOCAL_ROOT[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), f"{package.name}-functions.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def use_checkpoints(spark: SparkSession) -> None:
    """Lets iterative learners cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """What runs inside is generated in methods that the JVM compiles, also where its options were not set."""
    before = spark.conf.get(METHOD_LIMIT, None)
    spark.conf.set(METHOD_LIMIT, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT)
        else:
            spark.conf.set(METHOD_LIMIT, before)


PART_ROWS = 250_000


def sized_parts(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows: as configured, more where a task would get over ``PART_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


@contextmanager
def small_tasks(spark: SparkSession, parts: int, writers: int = 512) -> Iterator[None]:
    """What runs inside starts its shuffles with so many parts, and writes up to so many files at once instead of sorting by file."""
    wanted = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": parts, "spark.sql.maxConcurrentOutputFileWriters": writers}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back.

    A written table survives the loss of any executor and gives the optimizer
    real sizes for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with compiled_methods(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
