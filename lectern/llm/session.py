"""Session helpers of this subpackage: where lineage is cut, and how wide exchanges are."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the batches that go to Python workers at most; the session's default is eight times that, on both sides of the pipe.
BATCH = 8 << 20
#: Allocator settings of Python workers: large arrays go back to the system when they are freed, also after a long document.
WORKER = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python, let workers import the package from where the driver has it, and give the session a checkpoint folder: the cluster's ``spark.checkpoint.dir``, or one in the warehouse, which is shared too, where that is unset."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    sc.environment.update(WORKER)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/lectern-checkpoints")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's own folder under the checkpoint directory."""
    return ready(spark).sparkContext._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str | None:
    """The same as a path, if it is one, for scratch files of tasks."""
    at = urlparse(checkpoint_folder(spark))
    return f"{at.path}/scratch" if at.scheme in ("", "file") else None


#: Whether exchanges are deleted when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def exchanges_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, what actions exchange is deleted when each is done. Every exchange leaves a few small files of each task, so those of many short rounds take more room than what they carry."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, written as Parquet under the checkpoint folder and read again: lineage ends here, in less room than a checkpoint takes. The exchanges of this write are deleted when it is done, as nothing reads them again; the table goes when the driver ends, or by ``remove``."""
    spark = rows.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with exchanges_deleted(spark):
        rows.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written under the checkpoint folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def width(df: DataFrame, factor: float = 1.0) -> int:
    """Partitions for an exchange: the session's setting, which is sized to the input, times ``factor``."""
    return max(2, round(factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
