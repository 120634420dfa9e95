"""Category codes to one-hot vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.schema import CODES


def fit_encoder(df: DataFrame, columns: Sequence[str] = CODES) -> PipelineModel:
    """Learn the labels of ``columns``: most frequent first, ties by name.

    Null and unknown codes are kept as an all-zero vector; every known label has its
    own slot (``dropLast`` drops the slot for unknown ones). One grouped count gives the labels of
    all columns. They go to the driver and with the model to every task, because the model
    is the list of its labels: encode codes, not keys.
    """
    labels = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("place"), F.col(c).cast("string").alias("label"))
                    for k, c in enumerate(columns)
                ]
            )
        ).alias("code")
    ).select("code.*")
    counts = labels.where("label IS NOT NULL").groupBy("place", "label").count()
    found: list[list[str]] = [[] for _ in columns]
    for row in counts.orderBy("place", F.desc("count"), "label").collect():
        found[row["place"]].append(row["label"])
    indexed = [f"{c}_indexed" for c in columns]
    encoded = [f"{c}_encoded" for c in columns]
    indexers = [
        StringIndexerModel.from_labels(labels, inputCol=c, outputCol=i, handleInvalid="keep")
        for labels, c, i in zip(found, columns, indexed)
    ]
    known = PipelineModel(stages=indexers)
    # The widths of the vectors are in the schema, so this reads no row.
    one_hot = OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True).fit(
        known.transform(df.limit(0))
    )
    return PipelineModel(stages=[*indexers, one_hot])


def encode_categories(
    df: DataFrame, columns: Sequence[str] = CODES, encoder: PipelineModel | None = None
) -> tuple[DataFrame, PipelineModel]:
    """Add ``*_indexed`` and ``*_encoded``; also return the fitted encoder for reuse."""
    encoder = encoder or fit_encoder(df, columns)
    return encoder.transform(df), encoder
