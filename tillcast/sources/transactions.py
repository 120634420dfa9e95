"""Reading transaction files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillcast.functions.amounts import to_amount, to_count
from tillcast.schema import (
    CODES,
    MALFORMED,
    MERCHANT,
    RAW_COUNT,
    RAW_MONTH,
    RAW_SALES,
    SOURCE_FILE,
)


def read_raw_transactions(
    spark: SparkSession, path: str | list[str], report: bool = False
) -> DataFrame:
    """CSV files with a header, all fields as text.

    Columns are found by their header name. Types are not inferred, that would be one more
    pass over all files; ``enforceSchema`` off makes a file whose header
    differs an error instead of silently swapped columns.

    With ``report`` each row also has the name of its file and, if its line has too few or too many fields or
    broken quotes, the line: ``rejected_transactions`` lists them and ``clean_transactions`` gives them no month. Of a
    line whose quotes end early the fields are put together as they were read. All columns are parsed then.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    plain = reader.option("inferSchema", False).csv(path)
    if not report:
        return plain
    fields = [F.col(f"`{c}`") for c in plain.columns]
    schema = StructType([*plain.schema.fields, StructField(MALFORMED, StringType())])
    rows = (
        reader.schema(schema)
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)  # else lines are judged by the columns asked for
        .csv(path)
    )
    # A quoted field that goes on behind its closing quote is read with its quotes.
    broken = reduce(or_, [F.coalesce(f.startswith('"'), F.lit(False)) for f in fields])
    line = F.when(broken, F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]))
    return rows.withColumns(
        {MALFORMED: F.coalesce(MALFORMED, line), SOURCE_FILE: F.col("_metadata.file_path")}
    )


def read_transactions(
    spark: SparkSession, path: str | list[str], report: bool = False
) -> DataFrame:
    """Transactions with amounts as double and counts as bigint, null if unreadable."""
    return read_raw_transactions(spark, path, report).select(
        MERCHANT,
        *CODES,
        RAW_MONTH,
        to_amount(RAW_SALES).alias(RAW_SALES),
        to_count(RAW_COUNT).alias(RAW_COUNT),
        *((MALFORMED, SOURCE_FILE) if report else ()),
    )
