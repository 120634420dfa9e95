"""Calendar-month expressions. All results are dates, so no time zone is involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def month_start(column: str | Column) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(column, "month")


def month_of(df: DataFrame, name: str) -> Column:
    """First day of the month in column ``name`` of ``df``.

    Dates and timestamps are truncated; anything else is read as six digits
    ``yyyyMM`` and gives null when it is not a month.
    """
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return month_start(name)
    text = F.trim(F.col(name).cast("string"))
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(text, "yyyyMM"))


def month_number(column: str | Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(column) * 12 + F.month(column)


def calendar_months(first: Column, last: Column) -> Column:
    """How many months there are from ``first`` to ``last``, both counted."""
    return month_number(last) - month_number(first) + 1


def months_between_inclusive(first: Column, last: Column) -> Column:
    """Array of every month from ``first`` to ``last``; null if that is no range."""
    return F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL '1' MONTH")))


def next_months(month: Column, count: int) -> Column:
    """Array of the ``count`` months after ``month``."""
    return months_between_inclusive(F.add_months(month, 1), F.add_months(month, count))
