"""Shared folders and lineage cuts."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# The folder below the shared one in which intermediate tables are put.
_FOLDER = contextvars.ContextVar("folder", default="sparsight")


@functools.cache
def _local_test_dir() -> str:
    return tempfile.mkdtemp(prefix="sparsight-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master with the setting unset.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_test_dir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{_FOLDER.get()}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside the block go when it ends.

    What reads them must be done by then: results are to be written or collected inside.
    """
    folder = f"sparsight/run-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    path = f"{shared_dir(spark)}/{folder}"
    try:
        yield path
    finally:
        _FOLDER.reset(token)
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table and read it back.

    Used where a result feeds several branches or a loop: the table survives
    the loss of any executor and the plan that reads it starts at a scan.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
