"""Raw transactions to typed transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.amounts import to_amount, to_count
from tillcast.functions.months import month_of, month_start
from tillcast.schema import MALFORMED, MERCHANT, MONTH_DT, RAW_COUNT, RAW_MONTH, RAW_SALES


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Add the month as a date; make amounts double and counts bigint.

    Unreadable or missing amounts and counts become zero (NaN too), an
    unreadable month becomes null, and so does that of a malformed line, if these are reported: its
    fields may belong to other columns. No row is dropped and nothing is shuffled.
    """
    month = month_of(raw, RAW_MONTH)
    if MALFORMED in raw.columns:
        month = F.when(F.col(MALFORMED).isNull(), month)
    return raw.withColumns(
        {
            MONTH_DT: month,
            RAW_SALES: to_amount(RAW_SALES),
            RAW_COUNT: to_count(RAW_COUNT),
        }
    ).fillna(0, subset=[RAW_SALES, RAW_COUNT])


def rejected_transactions(rows: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Rows whose sales cannot enter a series, with the reason.

    Takes cleaned rows, or raw ones; only those still hold amounts that are not finite. With the calendar
    ``bounds`` rows outside of it are reported. Without them the rows themselves set the calendar, and
    one wrong month lengthens every series: look at ``suspect_months`` first. Lines that are no proper rows come
    with their text and file if the rows were read with ``report``.
    """
    number = F.col(RAW_SALES).try_cast("double")
    if MONTH_DT not in rows.columns:
        rows = rows.withColumn(MONTH_DT, month_of(rows, RAW_MONTH))
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in rows.columns else F.lit(False)
    reason = (
        F.when(malformed, "malformed line")
        .when(F.col(MERCHANT).isNull(), "no merchant")
        .when(F.col(MONTH_DT).isNull(), "no month")
        .when(~(F.abs(number) < F.lit(float("inf"))), "amount not finite")
    )
    if bounds is not None:
        span = bounds.select(F.struct("first_month", "last_month")).scalar()
        inside = month_start(MONTH_DT).between(
            span.getField("first_month"), span.getField("last_month")
        )
        reason = reason.when(~inside, "month outside the calendar")
    return rows.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())
