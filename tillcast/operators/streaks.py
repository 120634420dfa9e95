"""Runs of consecutive months with sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.months import month_number
from tillcast.schema import MERCHANT, MONTH, SALES


def positive_streaks(series: DataFrame) -> DataFrame:
    """One row per unbroken run of months with sales above zero.

    Within a run the month number minus the row number does not change. The
    grouping starts with the merchant, so it reuses the window's partitioning.
    """
    rank = F.row_number().over(Window.partitionBy(MERCHANT).orderBy(MONTH))
    return (
        series.where(F.col(SALES) > 0)
        .select(MERCHANT, MONTH, (month_number(MONTH) - rank).alias("run"))
        .groupBy(MERCHANT, "run")
        .agg(
            F.min(MONTH).alias("streak_start"),
            F.max(MONTH).alias("streak_end"),
            F.count(F.lit(1)).alias("streak_months"),
        )
        .drop("run")
    )
