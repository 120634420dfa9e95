"""Months that should not set the calendar.

Every merchant's series runs from the first to the last month of the data, so one row dated wrongly, such as 0001-01
or 9999-12, makes a hundred thousand months of each merchant. These functions say so before a series is
built. Nothing is cut off: give ``continuous_series`` the bounds you mean, or mend the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.months import month_start
from tillcast.schema import MERCHANT, MONTH, MONTH_DT

#: Months without any row that set apart what lies beyond them.
MAX_GAP = 12
#: A month at either end with less than this share of a typical month's rows is thin.
THIN_SHARE = 0.01
#: Months named in an error.
NAMED = 20


def month_support(df: DataFrame) -> DataFrame:
    """Rows and merchants of each month of cleaned transactions: what the calendar rests on."""
    by_merchant = (
        df.where(F.col(MERCHANT).isNotNull() & F.col(MONTH_DT).isNotNull())
        .groupBy(month_start(MONTH_DT).alias(MONTH), MERCHANT)
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return by_merchant.groupBy(MONTH).agg(
        F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("merchants")
    )


def suspect_months(
    df: DataFrame, max_gap: int = MAX_GAP, thin_share: float = THIN_SHARE
) -> DataFrame:
    """The months with their support that a calendar should not end at, and why.

    ``beyond a gap``: more than ``max_gap`` empty months lie between the month and the run of months that has
    the most rows. ``thin end``: it and all months from it to the nearer end of that run have fewer rows than ``thin_share``
    of the run's median month. There are at most 120,000 months from year 1 to 9999, so these windows stay
    small however many rows there are.
    """
    in_order = Window.orderBy(MONTH)
    number = F.year(MONTH) * 12 + F.month(MONTH)
    spaced = month_support(df).withColumn("empty_before", number - F.lag(number).over(in_order) - 1)
    runs = spaced.withColumn(
        "run", F.count_if(F.col("empty_before") > max_gap).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    of_run = Window.partitionBy("run")
    sized = runs.withColumns(
        {
            "run_rows": F.sum("row_count").over(of_run),
            "typical": F.percentile("row_count", F.lit(0.5)).over(of_run),
            "up_to": F.max("row_count").over(of_run.orderBy(MONTH).rowsBetween(Window.unboundedPreceding, 0)),
            "from_on": F.max("row_count").over(of_run.orderBy(MONTH).rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # The run with the most rows, the earlier one of equals.
    main = F.max(F.struct("run_rows", -F.col("run"))).over(Window.partitionBy())
    reason = F.when(F.col("run") != -main.getField("col2"), "beyond a gap").when(
        F.least("up_to", "from_on") < F.col("typical") * thin_share, "thin end"
    )
    return (
        sized.withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select(MONTH, "row_count", "merchants", F.col("empty_before").cast("int").alias("empty_before"), "reason")
    )


def require_plain_calendar(
    df: DataFrame, max_gap: int = MAX_GAP, thin_share: float = THIN_SHARE
) -> None:
    """Raise ``ValueError`` naming the first suspect months, if there are any."""
    found = suspect_months(df, max_gap, thin_share).orderBy(MONTH).limit(NAMED + 1).collect()
    if found:
        named = ", ".join(f"{r[MONTH]} ({r['row_count']} rows, {r['reason']})" for r in found[:NAMED])
        more = ", ..." if len(found) > NAMED else ""
        raise ValueError(f"months that should not set the calendar: {named}{more}")
