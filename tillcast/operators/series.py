"""Transactions to one row per merchant and calendar month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.amounts import exact_sum
from tillcast.functions.months import month_start, months_between_inclusive
from tillcast.schema import (
    CODES,
    ENCODED,
    INDEXED,
    MERCHANT,
    MONTH,
    MONTH_DT,
    OBSERVED,
    RAW_SALES,
    SALES,
)

#: Partitions of rows by merchant, at least. Not so few as their compressed size asks for: a merchant's rows
#: become all months of the calendar, which are sorted where they lie.
PARTITIONS = 256


def by_merchant(df: DataFrame) -> DataFrame:
    """``df`` in many small partitions by merchant; what groups or sorts by merchant next needs no other shuffle.

    Their number is ``spark.sql.shuffle.partitions`` if that is larger.
    """
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(PARTITIONS, few), MERCHANT)


def month_bounds(df: DataFrame, column: str = MONTH_DT) -> DataFrame:
    """One row with the first and last month of ``df``.

    Reads a single column and, being an aggregate without keys, is always one row.
    """
    return df.agg(
        month_start(F.min(column)).alias("first_month"),
        month_start(F.max(column)).alias("last_month"),
    )


def month_calendar(bounds: DataFrame) -> DataFrame:
    """Every month from the first to the last of the one-row ``bounds``."""
    months = months_between_inclusive(F.col("first_month"), F.col("last_month"))
    return bounds.select(F.explode(months).alias(MONTH))


def monthly_totals(df: DataFrame) -> DataFrame:
    """The months in which a merchant has rows, with their sales; no gaps are filled.

    Rows without a month come as one null month with zero sales, so that the
    merchant stays known.
    """
    return sales_rows(df).groupBy(MERCHANT, MONTH).agg(exact_sum(F.col(SALES)).alias(SALES))


def merchant_months(df: DataFrame) -> DataFrame:
    """One row per merchant and month with rows, and the codes kept for it.

    The observed part of :func:`continuous_series`, with a null month as in
    :func:`monthly_totals`.
    """
    extras = [c for c in (*INDEXED, *ENCODED) if c in df.columns]
    by_code = (
        sales_rows(df)
        .groupBy(MERCHANT, MONTH, *CODES)
        .agg(exact_sum(F.col(SALES)).alias(SALES), *[F.any_value(c, True).alias(c) for c in extras])
    )
    # Larger sales first, then names with null last. Combined before the shuffle, so a merchant
    # with many codes is its months when they come together.
    weight = F.struct(
        (-F.col(SALES)).alias("less"),
        *[x for c in CODES for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))],
    )
    monthly = by_code.groupBy(MERCHANT, MONTH).agg(
        exact_sum(F.col(SALES)).alias(SALES),
        F.min_by(F.struct(*CODES, *extras), weight).alias("kept"),
    )
    return monthly.select(MERCHANT, MONTH, SALES, *[F.col(f"kept.{c}") for c in (*CODES, *extras)])


def continuous_series(df: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """One row per merchant and month, zero sales where there were none.

    All merchants run over the same calendar: the one-row ``bounds`` (see
    :func:`month_bounds`), by default those of ``df`` itself. Hand them in when
    a cheaper source for them exists, ``df`` is then read once only.

    Rows of the same merchant and month are summed; the codes kept are those
    with the larger sales, ties by name. Sales come from
    ``sales_amount_actual`` or ``sales_amount``, else they are zero; missing code
    columns are null, index and vector columns pass through if present. Filled-in
    months have null codes and ``has_transactions`` false. Rows without
    merchant are left out, see ``rejected_transactions``.

    Plan: the sums are combined before the shuffle, so a merchant with very
    many rows shrinks to its months; one more shuffle brings a merchant's months
    together and the gaps are filled from there by windows and ``explode``. The
    result is partitioned by merchant, which the operators on it reuse.
    """
    bounds = month_bounds(df) if bounds is None else bounds
    first_month, last_month = calendar_ends(bounds)
    extras = [c for c in (*INDEXED, *ENCODED) if c in df.columns]

    # Each row stands for the months up to the merchant's next one, the first
    # row also for those before it.
    by_month = Window.partitionBy(MERCHANT).orderBy(MONTH)
    filled = merchant_months(df).withColumns(
        {
            "from_month": F.when(F.row_number().over(by_month) == 1, first_month).otherwise(
                F.greatest(F.col(MONTH), first_month)
            ),
            "to_month": F.least(F.add_months(F.lead(MONTH).over(by_month), -1), last_month),
        }
    ).select(
        "*",
        F.explode(months_between_inclusive(F.col("from_month"), F.col("to_month"))).alias("slot"),
    )
    observed = F.col("slot").eqNullSafe(F.col(MONTH))
    return filled.select(
        MERCHANT,
        F.col("slot").alias(MONTH),
        F.when(observed, F.col(SALES)).otherwise(F.lit(0.0)).alias(SALES),
        *[F.when(observed, F.col(c)).alias(c) for c in (*CODES, *extras)],
        observed.alias(OBSERVED),
    )


def sales_rows(df: DataFrame) -> DataFrame:
    """Rows with a merchant, in the columns a series is made of.

    Unknown sales are zero, and so are those of rows without a month: they belong
    nowhere in the calendar.
    """
    sales = next((F.col(c) for c in (SALES, RAW_SALES) if c in df.columns), F.lit(0.0))
    known = F.coalesce(F.nanvl(sales.cast("double"), F.lit(0.0)), F.lit(0.0))
    codes = [
        (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in CODES
    ]
    extras = [c for c in (*INDEXED, *ENCODED) if c in df.columns]
    return df.where(F.col(MERCHANT).isNotNull()).select(
        MERCHANT,
        month_start(MONTH_DT).alias(MONTH),
        F.when(F.col(MONTH_DT).isNotNull(), known).otherwise(F.lit(0.0)).alias(SALES),
        *codes,
        *extras,
    )


def calendar_ends(bounds: DataFrame) -> tuple[Column, Column]:
    """The two months of the one-row ``bounds`` as scalar subqueries."""
    span = bounds.select(F.struct(F.col("first_month"), F.col("last_month"))).scalar()
    return span.getField("first_month"), span.getField("last_month")


def clip_to_calendar(rows: DataFrame, first_month: Column, last_month: Column) -> DataFrame:
    """Rows outside the calendar lose their month and sales, as in a series."""
    inside = F.col(MONTH).between(first_month, last_month)
    return rows.withColumns(
        {
            MONTH: F.when(inside, F.col(MONTH)),
            SALES: F.when(inside, F.col(SALES)).otherwise(F.lit(0.0)),
        }
    )
