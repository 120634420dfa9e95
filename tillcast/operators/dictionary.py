"""Category codes to one-hot vectors when there are too many labels for a model to hold.

The same indexes and vectors as those of ``fit_encoder``, but the labels are a table and never on the
driver. For some hundred codes the fitted encoder is the better choice: it is part of the saved model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillcast.functions.lineage import cut_lineage, scratch
from tillcast.functions.ranks import with_place
from tillcast.schema import CODES


@dataclass(frozen=True)
class Dictionary:
    """A table of labels (``code``, ``label``, ``slot``, ``rows``) at ``path``, and how many each code has."""

    path: str
    sizes: dict[str, int]

    def labels(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("code STRING, label STRING, slot BIGINT, rows BIGINT").parquet(self.path)


def fit_dictionary(df: DataFrame, path: str, columns: Sequence[str] = CODES) -> Dictionary:
    """Learn the labels of ``columns`` and write them to ``path``: most frequent first, ties by name.

    One grouped count, combined before the shuffle, gives the labels of all columns; they are
    numbered in sampled ranges.
    """
    labels = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("string").alias("label")) for c in columns])
        ).alias("x")
    ).select("x.*")
    counts = labels.where("label IS NOT NULL").groupBy("code", "label").agg(F.count(F.lit(1)).alias("rows"))
    with scratch(df.sparkSession) as place:
        numbered = with_place(
            cut_lineage(counts, place), "code", [F.desc("rows"), F.asc("label")], place, "slot"
        )
        numbered.select("code", "label", "slot", "rows").write.mode("overwrite").parquet(path)
    return read_dictionary(df.sparkSession, path, columns)


def read_dictionary(spark: SparkSession, path: str, columns: Sequence[str] = CODES) -> Dictionary:
    """The dictionary at ``path``; of each column only its number of labels comes to the driver."""
    labels = Dictionary(path, {}).labels(spark)
    found = {r["code"]: r["n"] for r in labels.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Dictionary(path, {c: found.get(c, 0) for c in columns})


def index_categories(df: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Add ``*_indexed``: the slot of the label, or the number of labels for null and unknown ones.

    One join a column, of two sides that are exchanged for it, so that AQE can split a label which most rows have.
    """
    labels = dictionary.labels(df.sparkSession)
    for column, size in dictionary.sizes.items():
        own = labels.where(F.col("code") == column).select(
            F.col("label").alias("label_"), F.col("slot").alias("slot_")
        )
        df = (
            df.join(own, F.col(column).cast("string") == F.col("label_"), "left")
            .withColumn(f"{column}_indexed", F.coalesce("slot_", F.lit(size)).cast("double"))
            .drop("label_", "slot_")
        )
    return df


def encode_with_dictionary(df: DataFrame, dictionary: Dictionary, folder: str) -> DataFrame:
    """Add ``*_indexed`` and ``*_encoded``, written below ``folder``.

    Vectors are sparse, whatever their width: null and unknown labels have no entry. They are written as
    the plain fields of a vector and read as vectors, which needs neither a function in Python nor a
    list of labels.
    """
    indexed = index_categories(df, dictionary)
    vectors = {
        f"{c}_encoded": _sparse(F.col(f"{c}_indexed"), size) for c, size in dictionary.sizes.items()
    }
    rows = cut_lineage(indexed.withColumns(vectors), folder)
    schema = StructType(
        [StructField(f.name, VectorUDT() if f.name in vectors else f.dataType, f.nullable) for f in rows.schema]
    )
    return df.sparkSession.read.schema(schema).parquet(*{f.rsplit("/", 1)[0] for f in rows.inputFiles()})


def _sparse(index: Column, size: int) -> Column:
    known = index < size
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.when(known, F.array(index.cast("int"))).otherwise(F.array().cast("array<int>")).alias("indices"),
        F.when(known, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"),
    )
