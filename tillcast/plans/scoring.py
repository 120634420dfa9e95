"""From raw transactions to forecasts and offers of all merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillcast.operators.cleaning import clean_transactions
from tillcast.operators.forecasting import mean_forecast_from_transactions
from tillcast.operators.offers import only_requested, score_offers_from_totals
from tillcast.operators.series import month_bounds, monthly_totals
from tillcast.schema import HORIZON_MONTHS, AdvancePolicy


def forecast_all(
    raw: DataFrame, horizon: int = HORIZON_MONTHS, jitter: float = 0.05, seed: int = 0
) -> DataFrame:
    """Mean forecasts of every merchant."""
    return mean_forecast_from_transactions(
        clean_transactions(raw), horizon=horizon, jitter=jitter, seed=seed
    )


def offers_from_transactions(
    cleaned: DataFrame,
    bounds: DataFrame | None = None,
    requests: DataFrame | None = None,
    horizon: int = HORIZON_MONTHS,
    jitter: float = 0.05,
    seed: int = 0,
    policy: AdvancePolicy = AdvancePolicy(),
) -> DataFrame:
    """Offers as of the last month of the calendar, which is that of ``cleaned`` by default.

    With ``requests`` only the transactions of the merchants asked for are summed up.
    """
    bounds = month_bounds(cleaned) if bounds is None else bounds
    return score_offers_from_totals(
        monthly_totals(only_requested(cleaned, requests)), bounds, requests, horizon, jitter, seed, policy
    )
