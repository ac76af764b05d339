"""Tables written to the shared scratch folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUN: ContextVar[str | None] = ContextVar("scratch_run", default=None)
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    A session without one gets a folder under the warehouse, which every executor reaches too; it goes with the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if not configured:
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            _OWN[application] = f"{warehouse}/_scratch-{uuid.uuid4().hex}"
            files, path = _located(spark, _OWN[application])
            files.mkdirs(path)
            files.deleteOnExit(path)
        configured = _OWN[application]
    return configured.rstrip("/")


def _located(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _located(spark, folder)
    files.delete(path, True)


@contextmanager
def run_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """All scratch tables made inside the block lie in one folder, which goes at its end.

        with run_folder(spark, "pipeline"):
            run(spark, folder).write.parquet(output)

    Results are lazy, so what outlives the block must be written elsewhere inside it.
    """
    root = scratch_path(spark, label)
    before = _RUN.set(root)
    try:
        yield root
    finally:
        _RUN.reset(before)
        remove(spark, root)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_RUN.get() or scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once and read back: no lineage, and its size is known to the planner."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of an iterative job: each is written once, and all of them go when the job ends.

        with Rounds(spark, "job") as rounds:
            state = rounds.written(df)

    What outlives the job must be written elsewhere before the block ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self._spark, self._root, self._count = spark, scratch_path(spark, label), 0

    def __enter__(self) -> "Rounds":
        return self

    def written(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self._root}/{self._count}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *failure) -> None:
        remove(self._spark, self._root)
