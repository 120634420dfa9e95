"""Published result tables in global order, with a manifest that says which file holds whom."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.schema import MERCHANT, MONTH

ROWS, MANIFEST = "rows", "manifest"


def publish(df: DataFrame, folder: str, order: Sequence[str] = (MERCHANT, MONTH)) -> str:
    """Write ``df`` as Parquet to a new folder below ``folder`` and return its path.

    Rows are dealt to sampled ranges of ``order`` (those of its columns that ``df`` has, merchants as text) and
    sorted there, so the files, in order of their names, are one sorted table; a merchant with very many rows
    may go on in the next files. The manifest beside them, made from one column, has a row for each file: its first
    and last merchant and its rows. Lookups that read an earlier version go on undisturbed; hand the new path on.
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    name = F.col(MERCHANT).cast("string")
    keys = [name if c == MERCHANT else F.col(c) for c in order if c in df.columns]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/{ROWS}")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{ROWS}")
    manifest = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.coalesce(F.min(name), F.lit("")).alias("first"),
        F.coalesce(F.max(name), F.lit("")).alias("last"),
        F.count(F.lit(1)).alias("rows"),
    )
    manifest.coalesce(1).write.parquet(f"{path}/{MANIFEST}")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``first`` and ``last`` merchant and ``rows`` of each file of a published table."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_published(
    spark: SparkSession, path: str, requests: DataFrame | None = None
) -> DataFrame:
    """A published table; with ``requests`` only the files that may hold a merchant asked for.

    The manifest, a row for each file, comes to the driver as in any reader's planning. Requests do
    not: each finds its files among the boundaries where it lies, and only the numbers of files come back.
    If no file is needed the result is empty.
    """
    rows = spark.read.parquet(f"{path}/{ROWS}")
    if requests is None:
        return rows
    files = read_manifest(spark, path).orderBy("file").collect()
    needed = needed_files(requests, [f["first"] for f in files], [f["last"] for f in files])
    if not needed:
        return rows.limit(0)
    if len(needed) == len(files):
        return rows
    names = [f"{path}/{ROWS}/{files[k]['file']}" for k in needed]
    return spark.read.schema(rows.schema).parquet(*names)


def needed_files(requests: DataFrame, firsts: list[str], lasts: list[str]) -> list[int]:
    """Numbers of the files, sorted by merchant, in whose range a requested merchant lies."""
    merchant = F.col(MERCHANT).cast("string").alias("name")
    asked = requests.select(merchant).where("name IS NOT NULL").distinct()
    if not firsts:
        return []
    # A merchant may lie in every file from the first that ends at it or later to the last that begins
    # at it or earlier.
    spans = asked.select(
        _count(lasts, lambda last: last < F.col("name")).alias("from_"),
        (_count(firsts, lambda first: first <= F.col("name")) - 1).alias("to_"),
    ).where("from_ <= to_")
    numbers = spans.distinct().select(F.explode(F.sequence("from_", "to_")).alias("k")).distinct()
    return sorted(r["k"] for r in numbers.collect())


def _count(bounds: list[str], holds) -> Column:
    """How many of the sorted ``bounds`` a condition holds for that stops to hold somewhere.

    The bounds are looked at in blocks of about the square root of their number: first the blocks' beginnings,
    then one block.
    """
    width = max(1, isqrt(len(bounds)))
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    starts = F.lit([b[0] for b in blocks])
    block = F.size(F.filter(starts, holds))  # the place is in the block before
    inside = F.size(F.filter(F.get(F.lit(blocks), block - 1), holds))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside)
