"""Shared working storage: written tables that cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may run without that setting (a test); on a cluster a
    machine-local folder would not be visible to all executors, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="gleanery-")
    return _local_folder[app]


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object, so any store Spark can write works."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gleanery/{spark.sparkContext.applicationId}"


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when results are stored."""
    fs, target = file_system(spark, _own_dir(spark))
    fs.delete(target, True)


@contextmanager
def arrow_batches(spark: SparkSession, most: int = 2 << 20) -> Iterator[None]:
    """Inside the block Python workers get their rows in batches of about ``most`` bytes, however many rows that are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Intermediate tables of one job below the shared folder.

    Results may read them, so they stay until ``release`` (one job; also at the end of a
    ``with`` block) or ``release_all`` (the application).

    Unlike an RDD checkpoint the plan is computed once, columns can be pruned when the
    table is read back, and its exact size is known to the optimizer.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{_own_dir(spark)}/{job}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        fs, target = file_system(self.spark, self.root)
        fs.delete(target, True)
