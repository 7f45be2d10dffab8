"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "gavelworks") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Timestamps at rest are UTC, and every calendar feature is read in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder. On a
    cluster a machine-local folder would not survive an executor, so there the
    setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="gavelworks-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str = "step", compression: str | None = None, more: Sequence[DataFrame] = ()) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors.

    Unlike a checkpoint it is computed a single time, and later steps read
    only the columns they need. The rows of ``more`` are added one frame after
    another.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for other in more:
        other.write.mode("append").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_batches(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Batches of about ``most`` bytes at the most for Python workers, in the jobs that are run meanwhile."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a query go as soon as it ends, not when the driver next collects its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan in at least as many pieces as there are cores.

    Text work is bound by CPU, and a small table may lie in one row group.
    Large tables come in enough pieces and are returned as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once a session, wherever they run.

    Not needed where the package is installed, or named in ``--py-files`` or ``PYTHONPATH``.
    """
    context = spark.sparkContext
    if getattr(context, "_has_gavelworks", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="gavelworks-"), "gavelworks_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("gavelworks", "registry"):
            for file in sorted((root / package).rglob("*.py")):
                out.write(file, file.relative_to(root))
    context.addPyFile(archive)  # the driver serves it to executors
    context._has_gavelworks = True
