"""Expressions on amounts, counts and predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_amount(column: str | Column) -> Column:
    """Text or number to double; null when it is not a finite number."""
    column = F.col(column) if isinstance(column, str) else column
    number = column.try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def to_count(column: str | Column) -> Column:
    """Text or number to bigint; fractions are cut off, null when not a number."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.try_cast("bigint"), column.try_cast("double").try_cast("bigint"))


def exact_sum(amount: Column) -> Column:
    """Sum of doubles as written, whatever their order: 0.1 + 0.2 - 0.3 is zero.

    Amounts are summed as decimals with ten places. A group with an amount that needs more places
    or is above 10**18 is summed as doubles.
    """
    decimal = amount.try_cast("decimal(28,10)")
    fits = F.coalesce(F.every(amount.isNull() | (decimal.cast("double") == amount)), F.lit(True))
    whole = F.coalesce(F.every(amount.isNull() | decimal.isNotNull()), F.lit(True))
    return F.when(fits & whole, F.sum(decimal).cast("double")).otherwise(F.sum(amount))


def not_below_zero(column: Column) -> Column:
    """Negative values become zero; null stays null (``greatest`` would lose it)."""
    return F.when(column < 0, F.lit(0.0)).otherwise(column)


def jitter_factor(merchant: Column, month: Column, jitter: float, seed: int) -> Column:
    """Factor in ``[1 - jitter, 1 + jitter)`` fixed by merchant, month and seed.

    A hash instead of ``rand``: a retried task or another partitioning gives
    the same forecast.
    """
    if jitter == 0:
        return F.lit(1.0)
    text = F.concat_ws(
        "|", merchant.cast("string"), F.date_format(month, "yyyy-MM-dd"), F.lit(str(seed))
    )
    unit = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.lit(1.0) + (unit - F.lit(0.5)) * F.lit(2.0 * jitter)
