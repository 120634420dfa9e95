"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written
from tillcast.llm.lines import dedup_lines
from tillcast.llm.minhash import near_copies
from tillcast.llm.packing import pack_documents
from tillcast.llm.quality import fit_quality_model, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the classifier learns from those that have labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    labelled = docs.select("doc_id", "text").join(labels, "doc_id")
    return keep_good(docs, fit_quality_model(labelled))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document keeps; ``n_chars`` is counted anew."""
    deduped = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return deduped.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without any word are no copies of anything and stay. The ids that go are written first: if
    Spark finds their file small enough it broadcasts them, and the texts are not shuffled.
    """
    gone = near_copies(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    gone = written(gone, workspace(spark, "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and where they lie in sequences of 2,048 tokens."""
    return pack_documents(
        docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), workspace(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the packing are not expressible in SQL.
ORACLE_SQL = None
