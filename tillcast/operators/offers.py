"""Advance amounts, offers for all merchants, and lookups of both."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.months import calendar_months
from tillcast.operators.eligibility import (
    REASONS,
    AsOf,
    as_of_column,
    asof_aggregates,
    verdict_columns,
    with_latest_run,
)
from tillcast.operators.forecasting import mean_prediction
from tillcast.operators.series import calendar_ends, clip_to_calendar
from tillcast.schema import (
    HORIZON_MONTHS,
    MERCHANT,
    MONTH,
    PREDICTION,
    SALES,
    AdvancePolicy,
)


def advance_amounts(
    forecasts: DataFrame,
    merchants: DataFrame | None = None,
    policy: AdvancePolicy = AdvancePolicy(),
) -> DataFrame:
    """Advance per merchant: a share of its forecast sales.

    With ``merchants``, those without forecasts are listed with 0.0.
    """
    amounts = forecasts.groupBy(MERCHANT).agg(
        (F.coalesce(F.sum(PREDICTION), F.lit(0.0)) * policy.advance_rate).alias("advance_amount")
    )
    if merchants is None:
        return amounts
    return (
        merchants.select(MERCHANT)
        .distinct()
        .join(amounts, MERCHANT, "left")
        .fillna(0.0, subset=["advance_amount"])
    )


def score_offers(
    series: DataFrame,
    requests: DataFrame | None = None,
    as_of: AsOf = None,
    horizon: int = HORIZON_MONTHS,
    jitter: float = 0.05,
    seed: int = 0,
    policy: AdvancePolicy = AdvancePolicy(),
) -> DataFrame:
    """Verdict and advance of every merchant, or of the requested ones.

    Features, mean and latest month come from one grouped pass over ``series`` and the
    forecast months are expressions on its row, so eligibility and forecast are
    not joined. Merchants that are not eligible get 0.0. Hand in ``as_of`` if it
    is known, the default reads ``series`` a second time.
    """
    as_of = as_of_column(series, as_of)
    measures = (
        with_latest_run(only_requested(series, requests), as_of)
        .groupBy(MERCHANT)
        .agg(
            *asof_aggregates(as_of),
            F.avg(SALES).alias("mean_sales"),
            F.max(MONTH).alias("latest_month"),
        )
    )
    return _offers(measures, requests, horizon, jitter, seed, policy)


def score_offers_from_totals(
    totals: DataFrame,
    bounds: DataFrame,
    requests: DataFrame | None = None,
    horizon: int = HORIZON_MONTHS,
    jitter: float = 0.05,
    seed: int = 0,
    policy: AdvancePolicy = AdvancePolicy(),
) -> DataFrame:
    """The offers of :func:`score_offers` without building the series.

    Works on ``monthly_totals`` and the calendar ``bounds``: months without sales add
    nothing to a sum, so they are counted from the calendar instead of being
    made, sorted and thrown away.
    """
    first_month, as_of = calendar_ends(bounds)
    measures = (
        with_latest_run(
            clip_to_calendar(only_requested(totals, requests), first_month, as_of), as_of
        )
        .groupBy(MERCHANT)
        .agg(
            *asof_aggregates(as_of, first_month),
            (F.sum(SALES) / calendar_months(first_month, as_of)).alias("mean_sales"),
        )
        .withColumn("latest_month", as_of)
    )
    return _offers(measures, requests, horizon, jitter, seed, policy)


def _offers(
    measures: DataFrame,
    requests: DataFrame | None,
    horizon: int,
    jitter: float,
    seed: int,
    policy: AdvancePolicy,
) -> DataFrame:
    forecast_months = [
        mean_prediction(
            F.col("mean_sales"),
            F.col(MERCHANT),
            F.add_months("latest_month", k),
            jitter,
            seed,
        )
        for k in range(1, horizon + 1)
    ]
    amount = F.coalesce(reduce(add, forecast_months), F.lit(0.0)) * policy.advance_rate
    offers = measures.withColumns(verdict_columns(policy)).select(
        MERCHANT,
        *REASONS,
        "is_eligible",
        F.when(F.col("is_eligible"), amount).otherwise(F.lit(0.0)).alias("advance_amount"),
    )
    return offers if requests is None else lookup_offers(requests, offers)


def lookup_forecasts(requests: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Requests with ``found`` and the merchant's forecasts in month order.

    Forecasts are gathered to one row per merchant first, at most the horizon each.
    """
    gathered = forecasts.groupBy(MERCHANT).agg(
        F.sort_array(F.collect_list(F.struct(MONTH, PREDICTION))).alias("by_month")
    )
    return _look_up(
        requests,
        gathered.select(MERCHANT, F.col(f"by_month.{PREDICTION}").alias("forecasted_sales")),
    )


def lookup_offers(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """Requests with ``found`` and the merchant's offer."""
    return _look_up(requests, offers)


def only_requested(rows: DataFrame, requests: DataFrame | None) -> DataFrame:
    """The rows of merchants that are asked for; all of them without requests or for a stream of them."""
    if requests is None or requests.isStreaming:
        return rows
    asked = requests.select(F.col(MERCHANT).cast("string").alias("asked")).distinct()
    return rows.join(asked, F.col(MERCHANT).cast("string") == F.col("asked"), "left_semi")


def _look_up(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Left join that stays even when most requests are for one merchant.

    AQE splits such a merchant's requests, but only where a join reads both sides
    straight from a shuffle. Answers grouped by merchant would be joined as they
    lie; the hash as a second key has them exchanged for the join.

    Ids are compared as text, whatever their type in the requests; a null id is not found.
    """
    name = F.col(MERCHANT).cast("string")
    keys = {"key_name": name, "key_hash": F.xxhash64(name)}
    answered = answers.withColumns({**keys, "found": F.lit(True)}).drop(MERCHANT)
    return (
        requests.withColumns(keys)
        .join(answered, ["key_name", "key_hash"], "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .drop("key_name", "key_hash")
    )
