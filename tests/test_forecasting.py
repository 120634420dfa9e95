from __future__ import annotations

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from conftest import TRANSACTIONS, month, months
from tillcast.operators.features import FEATURES, model_features
from tillcast.operators.forecasting import (
    mean_forecast,
    mean_forecast_from_transactions,
    model_forecast,
    model_forecast_from_transactions,
)
from tillcast.operators.encoding import encode_categories
from tillcast.operators.series import continuous_series


@pytest.fixture(scope="module")
def history(spark):
    a = [100, 120, 130, 110, 140, 150, 160, 170, 180, 190, 200, 210]
    rows = [
        ("merchant_A", "USD", "US", m, float(v), v // 10) for m, v in zip(months("2023-01", 12), a)
    ]
    rows += [
        ("merchant_B", "EUR", "FR", month(m), v, int(v) // 10)
        for m, v in (("2023-01", 50.0), ("2023-03", 60.0), ("2023-04", 70.0))
    ]
    encoded, _ = encode_categories(spark.createDataFrame(rows, TRANSACTIONS))
    return continuous_series(encoded)


def test_features(history):
    features = model_features(history)
    assert set(FEATURES) <= set(features.columns)
    counts = {r.anonymous_uu_id: r["count"] for r in features.groupBy("anonymous_uu_id").count().collect()}
    assert counts == {"merchant_A": 9, "merchant_B": 1}
    row = features.where("anonymous_uu_id = 'merchant_B'").first()
    assert row.transaction_month == month("2023-04")
    assert (row.sales_lag_1, row.sales_lag_2, row.sales_lag_3) == (60.0, 0.0, 50.0)
    assert row.ma_3_months == pytest.approx(130 / 3)
    assert row.ma_6_months == pytest.approx(180 / 4)
    assert (row.month_of_year, row.year) == (4, 2023)


def test_features_without_the_month_itself(history):
    row = (
        model_features(history, include_current=False)
        .where("anonymous_uu_id = 'merchant_A' and month_of_year = 12")
        .first()
    )
    assert row.ma_3_months == pytest.approx((200 + 190 + 180) / 3)
    assert row.ma_6_months == pytest.approx((200 + 190 + 180 + 170 + 160 + 150) / 6)


def test_features_need_one_shuffle_only(spark, history):
    stored = spark.createDataFrame([], history.schema)
    plan = model_features(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_mean_forecast(history):
    rows = mean_forecast(history, jitter=0.0).orderBy("anonymous_uu_id", "transaction_month").collect()
    assert [r.transaction_month for r in rows[:6]] == months("2024-01", 6)
    assert [r.prediction for r in rows] == pytest.approx([1860 / 12] * 6 + [180 / 12] * 6)


def test_mean_forecast_needs_no_series(spark):
    rows = [
        ("a", "USD", "US", month("2023-01"), 10.0, 1),
        ("a", "USD", "US", month("2023-04"), 2.0, 1),
        ("a", "EUR", "FR", month("2023-04"), float("nan"), 1),
        ("a", "USD", "US", None, 99.0, 1),
        ("b", "USD", "US", None, 5.0, 1),
        ("c", "USD", "US", month("2023-02"), -7.0, 1),
        (None, "USD", "US", month("2023-02"), 7.0, 1),
    ]
    df = spark.createDataFrame(rows, TRANSACTIONS)
    for jitter in (0.0, 0.05):
        direct = mean_forecast_from_transactions(df, jitter=jitter)
        assert sorted(direct.collect()) == sorted(
            mean_forecast(continuous_series(df), jitter=jitter).collect()
        )
    assert direct.where("anonymous_uu_id = 'a' and prediction > 0").count() == 6
    plan = mean_forecast_from_transactions(df)._jdf.queryExecution().executedPlan().toString()
    main = [line for line in plan.splitlines() if not line.lstrip().startswith(":")]
    assert sum("Exchange hashpartitioning" in line for line in main) == 1


def test_mean_forecast_horizon(history):
    assert mean_forecast(history, horizon=1, jitter=0.0).count() == 2
    with pytest.raises(ValueError):
        mean_forecast(history, horizon=0)


def test_negative_means_are_clamped(transactions):
    df = continuous_series(transactions(("m", months("2023-01", 2), [-5, 1])))
    assert {r.prediction for r in mean_forecast(df).collect()} == {0.0}


def test_jitter_stays_in_the_band_and_repeats(spark, transactions):
    df = continuous_series(
        transactions(*[(f"m{k}", months("2023-01", 2), [100, 100]) for k in range(300)])
    )
    first = mean_forecast(df, seed=3)
    values = [r.prediction for r in first.collect()]
    assert all(95 <= v < 105 for v in values)
    assert len(set(values)) > 1500
    assert abs(sum(values) / len(values) - 100) < 0.3
    again = mean_forecast(df.repartition(3, "transaction_month"), seed=3)
    assert sorted(again.collect()) == sorted(first.collect())
    assert sorted(mean_forecast(df, seed=4).collect()) != sorted(first.collect())


RULE = (
    "0.5 * sales_lag_1 + 0.25 * sales_lag_3 + 0.5 * ma_3_months - ma_6_months"
    " + 8 * month_of_year - (year - 2022) + length(country_code)"
)


@pytest.fixture(scope="module")
def rule():
    return PipelineModel(
        stages=[SQLTransformer(statement=f"SELECT *, {RULE} AS prediction FROM __THIS__")]
    )


def by_hand(sales, first_month, horizon, include_current):
    known = list(sales)
    out = []
    for m in months(first_month, horizon):
        n3, n6 = (2, 5) if include_current else (3, 6)

        def mean(n):
            last = known[-n:]
            return sum(last) / len(last)

        value = (
            0.5 * known[-1]
            + 0.25 * known[-3]
            + 0.5 * mean(n3)
            - mean(n6)
            + 8 * m.month
            - (m.year - 2022)
            + 2
        )
        known.append(max(value, 0.0))
        out.append((m, pytest.approx(known[-1])))
    return out


@pytest.mark.parametrize("include_current", [True, False])
def test_recursive_forecast_by_hand(history, rule, include_current):
    rows = model_forecast(history, rule, horizon=8, include_current=include_current).collect()
    a = [100, 120, 130, 110, 140, 150, 160, 170, 180, 190, 200, 210]
    b = [50, 0, 60, 70] + [0] * 8
    for merchant, sales in (("merchant_A", a), ("merchant_B", b)):
        got = sorted(
            (r.transaction_month, r.prediction) for r in rows if r.anonymous_uu_id == merchant
        )
        assert got == by_hand(sales, "2024-01", 8, include_current)


@pytest.mark.parametrize("length", [2, 3, 5, 9])
@pytest.mark.parametrize("include_current", [True, False])
def test_recursive_forecast_needs_no_series(spark, length, include_current):
    rng = random.Random(length)
    codes = [("USD", "US"), ("EUR", "FRA"), (None, "GB"), ("EUR", None), (None, None)]
    rows = [
        (f"m{k}", *rng.choice(codes), m, float(rng.choice([-50, 0, 40, 90])), 1)
        for k in range(30)
        for m in rng.choices(months("2023-05", length), k=rng.randint(1, 2 * length))
    ] + [("never", "USD", "US", None, 5.0, 1)]
    df = spark.createDataFrame(rows, TRANSACTIONS)
    rule = PipelineModel(
        stages=[
            SQLTransformer(
                statement="SELECT *, sales_lag_1 - sales_lag_3 / 3 + ma_3_months + ma_6_months / 7"
                " + coalesce(length(currency_code), 0) * 5 + coalesce(length(country_code), 0)"
                " AS prediction FROM __THIS__"
            )
        ]
    )
    expected = model_forecast(continuous_series(df), rule, include_current=include_current)
    got = model_forecast_from_transactions(df, rule, include_current=include_current)

    def result(forecast):
        return {(r[0], r[1]): pytest.approx(r[2]) for r in forecast.collect()}

    assert result(got) == result(expected)
    assert got.where("prediction is null").count() == (6 * 31 if length < 3 else 0)


def test_short_history(transactions, rule):
    df = continuous_series(transactions(("m", months("2023-01", 2), [1, 2])))
    rows = model_forecast(df, rule).collect()
    assert len(rows) == 6 and all(r.prediction is None for r in rows)
    four = continuous_series(transactions(("m", months("2023-01", 4), [10, 20, 30, 40])))
    got = sorted((r.transaction_month, r.prediction) for r in model_forecast(four, rule).collect())
    assert got == by_hand([10, 20, 30, 40], "2023-05", 6, True)


def test_empty_history(spark, history, rule):
    empty = spark.createDataFrame([], history.schema)
    assert model_forecast(empty, rule).count() == 0
    assert mean_forecast(empty).count() == 0


def test_recursion_adds_no_shuffle(spark, history, rule):
    stored = spark.createDataFrame([], history.schema)
    for horizon in (1, 6):
        plan = model_forecast(stored, rule, horizon)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_codes_are_carried_forward(spark, rule):
    rows = [
        ("m", "USD", "US", month("2023-01"), 1.0, 1),
        ("m", "EUR", "FRA", month("2023-03"), 2.0, 1),
        ("n", "EUR", "FR", month("2023-06"), 2.0, 1),
    ]
    length = PipelineModel(
        stages=[
            SQLTransformer(
                statement="SELECT *, double(length(country_code)) AS prediction FROM __THIS__"
            )
        ]
    )
    df = continuous_series(spark.createDataFrame(rows, TRANSACTIONS))
    got = model_forecast(df, length, 1).select("anonymous_uu_id", "prediction").collect()
    assert sorted(tuple(r) for r in got) == [("m", 3.0), ("n", 2.0)]


def test_forecast_columns(history, rule):
    names = ["anonymous_uu_id", "transaction_month", "prediction"]
    assert mean_forecast(history).columns == names
    forecast = model_forecast(history, rule)
    assert forecast.columns == names
    assert dict(forecast.dtypes)["transaction_month"] == "date"
    assert forecast.where(F.col("prediction") < 0).count() == 0
