"""Forecasts of the next months: by mean, and by a model fed its own output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.amounts import exact_sum, jitter_factor, not_below_zero
from tillcast.functions.months import calendar_months, next_months
from tillcast.operators.features import AVERAGES, LAGS, calendar_features
from tillcast.operators.series import (
    calendar_ends,
    clip_to_calendar,
    merchant_months,
    month_bounds,
    sales_rows,
)
from tillcast.schema import CODES, HORIZON_MONTHS, MERCHANT, MONTH, PREDICTION, SALES

# Sales of the latest month, the one before and so on: what the longest average needs.
_KNOWN = tuple(f"known_{k}" for k in range(1, 7))


def mean_forecast(
    series: DataFrame, horizon: int = HORIZON_MONTHS, jitter: float = 0.05, seed: int = 0
) -> DataFrame:
    """Mean of a merchant's whole history for each of the next months.

    ``jitter`` varies each month by up to that share. One grouped pass; the
    months are made from its result.
    """
    means = series.groupBy(MERCHANT).agg(
        F.avg(SALES).alias("mean_sales"), F.max(MONTH).alias("latest_month")
    )
    return _from_means(means, horizon, jitter, seed)


def mean_forecast_from_transactions(
    cleaned: DataFrame,
    bounds: DataFrame | None = None,
    horizon: int = HORIZON_MONTHS,
    jitter: float = 0.05,
    seed: int = 0,
) -> DataFrame:
    """The forecast of :func:`mean_forecast` without building the series.

    The mean over a continuous series is a merchant's sales by the months of the calendar
    (one-row ``bounds``, by default that of ``cleaned``): one sum per merchant,
    combined before the only shuffle.
    """
    first_month, last_month = calendar_ends(month_bounds(cleaned) if bounds is None else bounds)
    months = calendar_months(first_month, last_month)
    means = (
        clip_to_calendar(sales_rows(cleaned), first_month, last_month)
        .groupBy(MERCHANT)
        .agg(exact_sum(F.col(SALES)).alias("total"))
        .select(
            MERCHANT,
            (F.col("total") / months).alias("mean_sales"),
            last_month.alias("latest_month"),
        )
    )
    return _from_means(means, horizon, jitter, seed)


def _from_means(means: DataFrame, horizon: int, jitter: float, seed: int) -> DataFrame:
    _check_horizon(horizon)
    prediction = mean_prediction(
        F.col("mean_sales"), F.col(MERCHANT), F.col(MONTH), jitter, seed
    )
    return means.select(
        MERCHANT, "mean_sales", F.explode(next_months(F.col("latest_month"), horizon)).alias(MONTH)
    ).select(MERCHANT, MONTH, prediction.alias(PREDICTION))


def mean_prediction(
    mean_sales: Column, merchant: Column, month: Column, jitter: float, seed: int
) -> Column:
    """The mean forecast of one month."""
    return not_below_zero(mean_sales * jitter_factor(merchant, month, jitter, seed))


def model_forecast(
    series: DataFrame,
    model: PipelineModel,
    horizon: int = HORIZON_MONTHS,
    include_current: bool = True,
) -> DataFrame:
    """Forecast the next months one after the other, each from those before it.

    A merchant is one row that carries its last six months and last known codes;
    every step adds the columns of one more month, so after the grouping there
    is no further join or shuffle however long the horizon. ``include_current`` must be
    what the model was trained with: the month to be forecast is unknown, so an
    average that would include it is over the months before it only. Merchants
    with less than three months of history get null forecasts.
    """
    return _forecast_from_state(_latest_state(series), model, horizon, include_current)


def model_forecast_from_transactions(
    cleaned: DataFrame,
    model: PipelineModel,
    bounds: DataFrame | None = None,
    horizon: int = HORIZON_MONTHS,
    include_current: bool = True,
) -> DataFrame:
    """The forecast of :func:`model_forecast` without building the series.

    The last six months are known from the calendar (one-row ``bounds``, by default that
    of ``cleaned``), so those without rows need not be made to find them.
    """
    first_month, last_month = calendar_ends(month_bounds(cleaned) if bounds is None else bounds)

    def known(k: int) -> Column:
        month = F.add_months(last_month, 1 - k)
        sales = F.coalesce(F.max(F.when(F.col(MONTH) == month, F.col(SALES))), F.lit(0.0))
        return F.when(month >= first_month, sales).alias(_KNOWN[k - 1])

    state = (
        clip_to_calendar(merchant_months(cleaned), first_month, last_month)
        .groupBy(MERCHANT)
        .agg(*_last_codes(), *[known(k) for k in range(1, len(_KNOWN) + 1)])
        .withColumn("latest_month", last_month)
    )
    return _forecast_from_state(state, model, horizon, include_current)


def _forecast_from_state(
    state: DataFrame, model: PipelineModel, horizon: int, include_current: bool
) -> DataFrame:
    _check_horizon(horizon)
    base = state.columns
    forecasts: list[str] = []
    for step in range(1, horizon + 1):
        history = [F.col(c) for c in (*reversed(forecasts), *_KNOWN)]
        name = f"forecast_{step}"
        predicted = model.transform(
            state.withColumns(_step_features(history, step, include_current))
        ).withColumn(
            name, F.when(F.col("known_3").isNotNull(), not_below_zero(F.col(PREDICTION)))
        )
        forecasts.append(name)
        state = predicted.select(*base, *forecasts)
    months = [
        F.struct(F.add_months("latest_month", k).alias(MONTH), F.col(c).alias(PREDICTION))
        for k, c in enumerate(forecasts, start=1)
    ]
    return state.select(MERCHANT, F.inline(F.array(*months)))


def _latest_state(series: DataFrame) -> DataFrame:
    """One row per merchant: latest month, last known codes, last six sales.

    Older months matter only where they have codes.
    """
    age = F.row_number().over(Window.partitionBy(MERCHANT).orderBy(F.col(MONTH).desc()))
    last_sales = [
        F.max(F.when(F.col("age") == k, F.col(SALES))).alias(name)
        for k, name in enumerate(_KNOWN, start=1)
    ]
    return (
        series.select(MERCHANT, MONTH, SALES, *CODES, age.alias("age"))
        .where((F.col("age") <= len(_KNOWN)) | F.coalesce(*CODES).isNotNull())
        .groupBy(MERCHANT)
        .agg(F.max(MONTH).alias("latest_month"), *_last_codes(), *last_sales)
    )


def _last_codes() -> list[Column]:
    return [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(MONTH))).alias(c) for c in CODES]


def _step_features(
    history: Sequence[Column], step: int, include_current: bool
) -> dict[str, Column]:
    """Features of the month ``step`` after the latest; ``history`` is latest first.

    Unknown lags are scored as zero, the result is thrown away by the caller.
    """
    zero = F.lit(0.0)
    unknown = 1 if include_current else 0
    averages = (_mean_known(history[: length - unknown]) for length in (3, 6))
    return {
        **{name: F.coalesce(history[k], zero) for k, name in enumerate(LAGS)},
        **{name: F.coalesce(mean, zero) for name, mean in zip(AVERAGES, averages)},
        **calendar_features(F.add_months("latest_month", step)),
    }


def _mean_known(values: Sequence[Column]) -> Column:
    total, count = F.lit(0.0), F.lit(0)
    for value in values:
        total = total + F.coalesce(value, F.lit(0.0))
        count = count + F.when(value.isNotNull(), 1).otherwise(0)
    return F.when(count > 0, total / count)


def _check_horizon(horizon: int) -> None:
    if horizon < 1:
        raise ValueError("the horizon is at least one month")
