"""Intermediate tables: written once, read by several jobs, removed when nobody reads them any more."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """``folder``, or the one the cluster names in ``spark.checkpoint.dir``.

    It must be on storage that outlives an executor.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("name a shared folder, or set spark.checkpoint.dir to one")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read from there.

    The files go to a new folder below :func:`shared_folder` and stay: use it for what is read after the caller
    has returned, and :func:`scratch` for the rest.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark, folder)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; nothing happens if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """A folder for intermediate tables, removed with all it holds at the end, also after a failure.

    Hand it to :func:`cut_lineage`. What is computed inside must be written or collected inside: a
    DataFrame that still reads from here fails later. A driver that is killed leaves the
    folder to the owner of the shared one; its name begins with ``scratch-``.
    """
    path = f"{shared_folder(spark, folder)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)
