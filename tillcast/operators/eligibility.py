"""The two definitions of eligibility features, and the verdict.

They differ on purpose: the windowed one counts rows back from a merchant's latest
month and wants the streak to reach it; the as-of one uses inclusive date
ranges (13 and 4 months) and takes the latest streak even if it has ended.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.months import calendar_months, month_number
from tillcast.schema import MERCHANT, MONTH, SALES, AdvancePolicy, WindowedPolicy

AsOf = datetime.date | str | Column | DataFrame | None


def windowed_eligibility(series: DataFrame, policy: WindowedPolicy = WindowedPolicy()) -> DataFrame:
    """Features and three flags per merchant, at the merchant's latest month.

    Months are numbered backwards in one window; what follows is one grouped
    pass over the same partitioning, without a join.
    """
    age = F.row_number().over(Window.partitionBy(MERCHANT).orderBy(F.col(MONTH).desc()))
    sold = F.coalesce(F.col(SALES) > 0, F.lit(False))
    recent, prior = F.col("recent"), F.col("prior")
    return (
        series.select(MERCHANT, SALES, age.alias("age"))
        .groupBy(MERCHANT)
        .agg(
            (F.coalesce(F.min(F.when(~sold, F.col("age"))) - 1, F.max("age")))
            .cast("bigint")
            .alias("consecutive_months_sales"),
            _mean_where(F.col("age") <= 12).alias("avg_sales_last_12_months"),
            _mean_where(F.col("age") <= 3).alias("recent"),
            _mean_where(F.col("age").between(4, 6)).alias("prior"),
        )
        .select(
            MERCHANT,
            "consecutive_months_sales",
            "avg_sales_last_12_months",
            F.when(prior > 0, (recent - prior) / prior).otherwise(0.0).alias("sales_trend_score"),
        )
        .withColumns(
            {
                "has_sufficient_history": F.col("consecutive_months_sales")
                >= policy.min_streak_months,
                "meets_min_avg_sales": F.col("avg_sales_last_12_months")
                >= policy.min_average_sales,
                "has_positive_trend": F.col("sales_trend_score") >= policy.min_trend,
            }
        )
    )


def asof_features(series: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Latest streak and three range averages per merchant, up to ``as_of``.

    ``as_of`` is a date, a one-row DataFrame or, by default, the latest month of
    ``series``; the default reads ``series`` a second time. Merchants without a row
    in the last twelve months are left out.
    """
    as_of = as_of_column(series, as_of)
    return (
        with_latest_run(series, as_of)
        .groupBy(MERCHANT)
        .agg(
            *asof_aggregates(as_of),
            F.count_if(F.col(MONTH).between(F.add_months(as_of, -12), as_of)).alias(
                "rows_last_12"
            ),
        )
        .where("rows_last_12 > 0")
        .drop("rows_last_12")
    )


def judge_eligibility(features: DataFrame, policy: AdvancePolicy = AdvancePolicy()) -> DataFrame:
    """Three reasons and ``is_eligible`` from as-of features."""
    return features.withColumns(verdict_columns(policy)).select(
        MERCHANT, *REASONS, "is_eligible"
    )


REASONS = ("is_sufficient_history", "meets_min_avg_sales", "has_stable_or_positive_trend")


def verdict_columns(policy: AdvancePolicy) -> dict[str, Column]:
    """The verdict as expressions over the as-of features."""
    recent, prior = F.col("avg_sales_recent_3_months"), F.col("avg_sales_prior_3_months")
    long_enough = F.col("latest_consecutive_months_with_sales") >= policy.min_streak_months
    large_enough = F.col("avg_sales_last_12_months") >= policy.min_average_sales
    holds_up = F.when(prior == 0, recent > 0).otherwise(
        recent >= prior * policy.min_recent_to_prior
    )
    return {
        **dict(zip(REASONS, (long_enough, large_enough, holds_up))),
        "is_eligible": long_enough & large_enough & holds_up,
    }


def as_of_column(series: DataFrame, as_of: AsOf) -> Column:
    """``as_of`` as a date expression; DataFrames become a scalar subquery."""
    if as_of is None:
        as_of = series.agg(F.max(MONTH))
    if isinstance(as_of, DataFrame):
        as_of = as_of.scalar()
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("date")


def with_latest_run(series: DataFrame, as_of: Column) -> DataFrame:
    """Rows up to ``as_of``, with ``in_latest_run`` true on the latest streak.

    Going back in time, month number plus the count of selling months so far stays
    the same through the latest streak and is lower after its first gap. Months
    may be missing, they are gaps; a null month is kept.
    """
    back = (
        Window.partitionBy(MERCHANT)
        .orderBy(F.col(MONTH).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sold = F.coalesce(F.col(SALES) > 0, F.lit(False))
    return (
        series.where((F.col(MONTH) <= as_of) | F.col(MONTH).isNull())
        .select(MERCHANT, MONTH, SALES, sold.alias("sold"), month_number(MONTH).alias("number"))
        .withColumns(
            {
                "sold_so_far": F.count_if("sold").over(back),
                "latest_sold": F.max(F.when(F.col("sold"), F.col("number"))).over(back),
            }
        )
        .select(
            MERCHANT,
            MONTH,
            SALES,
            "sold",
            (
                F.col("sold")
                & (F.col("number") + F.col("sold_so_far") == F.col("latest_sold") + 1)
            ).alias("in_latest_run"),
        )
    )


def asof_aggregates(as_of: Column, first_month: Column | None = None) -> list[Column]:
    """As-of features as aggregates over :func:`with_latest_run`; missing ones are 0.

    Averages are over the rows of a range. With ``first_month`` the rows need not
    include months without sales: sums are divided by the number of calendar
    months, which begin there and end with ``as_of``, the first day of a month.
    """
    year_ago, half_ago, quarter_ago = (F.add_months(as_of, -k) for k in (12, 6, 3))
    last_12 = F.col(MONTH).between(year_ago, as_of)
    recent = F.col(MONTH).between(quarter_ago, as_of)
    prior = (F.col(MONTH) >= half_ago) & (F.col(MONTH) < quarter_ago)

    def mean(condition: Column, first: Column, last: Column) -> Column:
        if first_month is None:
            average = F.avg(F.when(condition, F.col(SALES)))
        else:
            months = calendar_months(F.greatest(first, first_month), last)
            average = F.when(months > 0, F.sum(F.when(condition, F.col(SALES))) / months)
        return F.coalesce(average, F.lit(0.0))

    return [
        mean(last_12, year_ago, as_of).alias("avg_sales_last_12_months"),
        F.count_if(last_12 & F.col("sold")).alias("months_in_last_12_with_sales"),
        mean(recent, quarter_ago, as_of).alias("avg_sales_recent_3_months"),
        mean(prior, half_ago, F.add_months(as_of, -4)).alias("avg_sales_prior_3_months"),
        F.count_if("in_latest_run").alias("latest_consecutive_months_with_sales"),
    ]


def _mean_where(condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(SALES)))
