"""Places in an order that no single task could sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.lineage import cut_lineage


def with_place(
    df: DataFrame, group: str, order: Sequence[Column], folder: str, name: str = "place"
) -> DataFrame:
    """``df`` with the place, from 0, of every row in the order of its ``group``.

    Rows are dealt to sampled ranges and written below ``folder``; each range numbers its own rows and begins
    where the ranges before it end. Only the number of rows in each range comes together.
    """
    ranged = df.repartitionByRange(F.col(group), *order)
    ranged = cut_lineage(ranged.withColumn("range_", F.spark_partition_id()), folder)
    counts = ranged.groupBy(group, "range_").agg(F.count(F.lit(1)).alias("rows_"))
    earlier = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        group, "range_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("begin_")
    )
    within = Window.partitionBy(group, "range_").orderBy(*order)
    return (
        ranged.withColumn("nth_", F.row_number().over(within) - 1)
        .join(begins, [group, "range_"])
        .withColumn(name, (F.col("begin_") + F.col("nth_")).cast("long"))
        .drop("range_", "nth_", "begin_")
    )
