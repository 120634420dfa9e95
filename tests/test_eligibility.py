from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import TRANSACTIONS, month, months
from tillcast.operators.eligibility import (
    asof_features,
    judge_eligibility,
    windowed_eligibility,
)
from tillcast.operators.offers import score_offers
from tillcast.operators.series import continuous_series
from tillcast.plans.scoring import offers_from_transactions
from tillcast.schema import AdvancePolicy

YEAR = months("2023-01", 12)
SCENARIOS = {
    "m1": [5000, 5200, 5300, 5500, 5600, 5800, 6000, 6100, 6300, 6500, 6700, 7000],
    "m2": [0] * 9 + [4000, 4500, 5000],
    "m3": [1000, 1200, 1100, 1300, 1400, 1500, 1600, 1700, 1800, 1900, 2000, 2100],
    "m4": [10000, 9000, 8000, 7000, 6000, 5000, 2000, 1500, 1000, 900, 800, 700],
    "m5": [6000, 6200, 6500, 0, 7000, 7200, 7500, 7800, 8000, 8200, 8500, 8800],
    "m6": [6000, 6000, 6000, 0, 0, 0, 500, 1000, 1500, 6000, 6500, 7000],
}


@pytest.fixture(scope="module")
def windowed(spark):
    rows = [
        (name, m, float(amount))
        for name, amounts in SCENARIOS.items()
        for m, amount in zip(YEAR, amounts)
        if amount
    ]
    df = spark.createDataFrame(
        rows, "anonymous_uu_id string, transaction_month_dt date, sales_amount_actual double"
    )
    return {
        r.anonymous_uu_id: r for r in windowed_eligibility(continuous_series(df)).collect()
    }


@pytest.mark.parametrize(
    "name, streak, flags",
    [
        ("m1", 12, (True, True, True)),
        ("m2", 3, (False, False, True)),
        ("m3", 12, (True, False, True)),
        ("m4", 12, (True, False, False)),
        ("m5", 8, (False, True, True)),
        ("m6", 6, (False, False, True)),
    ],
)
def test_windowed_scenarios(windowed, name, streak, flags):
    row = windowed[name]
    assert row.consecutive_months_sales == streak
    assert (row.has_sufficient_history, row.meets_min_avg_sales, row.has_positive_trend) == flags
    assert row.avg_sales_last_12_months == pytest.approx(sum(SCENARIOS[name]) / 12)


def test_windowed_trend(windowed):
    assert windowed["m2"].sales_trend_score == 0.0
    assert windowed["m4"].sales_trend_score == pytest.approx((800 - 1500) / 1500)
    assert windowed["m6"].sales_trend_score == pytest.approx((6500 - 1000) / 1000)


def test_windowed_streak_must_reach_the_latest_month(transactions):
    df = transactions(("m", YEAR, [5] * 11 + [0]))
    assert windowed_eligibility(continuous_series(df)).first().consecutive_months_sales == 0


@pytest.fixture(scope="module")
def features(asof_panel):
    return asof_features(continuous_series(asof_panel), month("2024-06"))


@pytest.mark.parametrize(
    "name, streak, last_12, recent, prior, eligible",
    [
        ("merchant_A", 18, 6134.62, 6450.00, 6133.33, True),
        ("merchant_B", 5, 30750 / 13, 4650.00, 4050.00, False),
        ("merchant_C", 18, 323.08, 350.00, 333.33, False),
        ("merchant_D", 6, 1907.69, 3750.00, 3266.67, False),
        ("merchant_E", 18, 6000.00, 6000.00, 6000.00, True),
        ("merchant_F", 11, 4153.85, 0.00, 6000.00, False),
    ],
)
def test_asof_scenarios(features, name, streak, last_12, recent, prior, eligible):
    row = features.where(F.col("anonymous_uu_id") == name).first()
    assert row.latest_consecutive_months_with_sales == streak
    assert row.avg_sales_last_12_months == pytest.approx(last_12, abs=0.005)
    assert row.avg_sales_recent_3_months == pytest.approx(recent, abs=0.005)
    assert row.avg_sales_prior_3_months == pytest.approx(prior, abs=0.005)
    verdict = judge_eligibility(features).where(F.col("anonymous_uu_id") == name).first()
    assert verdict.is_eligible is eligible


def test_asof_forms_agree(asof_panel, features):
    series = continuous_series(asof_panel)
    expected = sorted(features.collect())
    assert sorted(asof_features(series).collect()) == expected
    assert sorted(asof_features(series, "2024-06-01").collect()) == expected
    one_row = series.agg(F.max("transaction_month"))
    assert sorted(asof_features(series, one_row).collect()) == expected


def test_asof_ignores_later_months(asof_panel):
    row = (
        asof_features(continuous_series(asof_panel), datetime.date(2023, 12, 1))
        .where("anonymous_uu_id = 'merchant_A'")
        .first()
    )
    assert row.latest_consecutive_months_with_sales == 12
    assert row.months_in_last_12_with_sales == 12


def test_merchants_without_rows_in_the_last_year_are_left_out(spark):
    series = spark.createDataFrame(
        [("old", month("2020-01"), 5.0), ("new", month("2023-01"), 5.0)],
        "anonymous_uu_id string, transaction_month date, sales_amount_actual double",
    )
    got = asof_features(series, month("2023-01")).collect()
    assert [r.anonymous_uu_id for r in got] == ["new"]
    offers = {r.anonymous_uu_id: r for r in score_offers(series, as_of=month("2023-01")).collect()}
    assert offers["old"].is_eligible is False and offers["old"].advance_amount == 0.0


@pytest.mark.parametrize(
    "recent, prior, passes",
    [
        (0.0, 0.0, False),
        (1.0, 0.0, True),
        (95.0, 100.0, True),
        (94.99, 100.0, False),
        (0.0, 100.0, False),
    ],
)
def test_trend_boundaries(spark, recent, prior, passes):
    row = spark.createDataFrame(
        [("m", 12, 5000.0, recent, prior)],
        "anonymous_uu_id string, latest_consecutive_months_with_sales bigint,"
        " avg_sales_last_12_months double, avg_sales_recent_3_months double,"
        " avg_sales_prior_3_months double",
    )
    verdict = judge_eligibility(row).first()
    assert verdict.has_stable_or_positive_trend is passes
    assert verdict.is_sufficient_history and verdict.meets_min_avg_sales
    assert verdict.is_eligible is passes


@pytest.mark.parametrize("length", [2, 5, 9, 20])
def test_offers_from_totals_are_those_from_the_series(spark, length):
    rng = random.Random(length)
    calendar = months("2022-05", length)
    rows = [
        (f"m{k}", "USD", "US", m, float(rng.choice([-100, 0, 6000, 9000])), 1)
        for k in range(60)
        for m in rng.sample(calendar, rng.randint(1, length))
    ] + [("never", "USD", "US", None, 5.0, 1)]
    df = spark.createDataFrame(rows, TRANSACTIONS)
    policy = AdvancePolicy(min_streak_months=1, min_average_sales=100.0, min_recent_to_prior=0.3)

    def result(offers):
        return {
            r.anonymous_uu_id: (*r[1:5], pytest.approx(r.advance_amount)) for r in offers.collect()
        }

    dense = result(score_offers(continuous_series(df), policy=policy))
    assert result(offers_from_transactions(df, policy=policy)) == dense
    assert any(v[3] for v in dense.values()) and not all(v[3] for v in dense.values())
    assert dense["never"][3] is False
