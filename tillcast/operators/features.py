"""Lag, moving-average and calendar features for the forecaster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.schema import ENCODED, MERCHANT, MONTH, OBSERVED, SALES

LAGS = ("sales_lag_1", "sales_lag_2", "sales_lag_3")
AVERAGES = ("ma_3_months", "ma_6_months")
LONGEST_AVERAGE = 6
CALENDAR = ("month_of_year", "year")
FEATURES = (*LAGS, *AVERAGES, *CALENDAR, *ENCODED)


def model_features(series: DataFrame, include_current: bool = True) -> DataFrame:
    """Add the features and keep the rows a model can learn from.

    Those have three earlier months and are not filled in: filled-in months
    feed lags and averages but are no examples. With ``include_current`` the
    averages contain the month itself, which is also the label; without it they
    end the month before, which is what a real forecast can know.
    """
    by_month = Window.partitionBy(MERCHANT).orderBy(MONTH)
    last = 0 if include_current else -1
    features = {name: F.lag(SALES, k).over(by_month) for k, name in enumerate(LAGS, start=1)}
    for name, length in zip(AVERAGES, (3, LONGEST_AVERAGE)):
        frame = by_month.rowsBetween(last - length + 1, last)
        features[name] = F.avg(SALES).over(frame)
    with_features = series.withColumns(features | calendar_features(F.col(MONTH)))
    if OBSERVED in series.columns:
        with_features = with_features.where(OBSERVED)
    return with_features.dropna(
        subset=[*LAGS, *AVERAGES, *[c for c in ENCODED if c in series.columns]]
    )


def calendar_features(month: Column) -> dict[str, Column]:
    """Month of the year and year."""
    return dict(zip(CALENDAR, (F.month(month), F.year(month))))
