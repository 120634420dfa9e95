from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import TRANSACTIONS, month, months
from tillcast.operators.encoding import encode_categories
from tillcast.operators.series import (
    continuous_series,
    month_bounds,
    month_calendar,
    monthly_totals,
)
from tillcast.operators.streaks import positive_streaks
from tillcast.sources import panels


def as_dict(series):
    return {
        (r.anonymous_uu_id, r.transaction_month): r.sales_amount_actual for r in series.collect()
    }


@pytest.fixture(scope="module")
def with_gap(transactions):
    return transactions(
        ("m1", [month("2023-01"), month("2023-03")], [100, 200]), ("m2", [month("2023-01")], [50])
    )


def test_gaps_are_zero(with_gap):
    got = as_dict(continuous_series(with_gap))
    assert got == {
        ("m1", month("2023-01")): 100.0,
        ("m1", month("2023-02")): 0.0,
        ("m1", month("2023-03")): 200.0,
        ("m2", month("2023-01")): 50.0,
        ("m2", month("2023-02")): 0.0,
        ("m2", month("2023-03")): 0.0,
    }


def test_filled_months_have_no_codes(with_gap):
    encoded, _ = encode_categories(with_gap)
    rows = continuous_series(encoded).collect()
    assert {"currency_code_indexed", "country_code_encoded"} <= set(rows[0].asDict())
    for row in rows:
        filled = row.sales_amount_actual == 0
        assert row.has_transactions is not filled
        assert (row.currency_code is None) is filled
        assert (row.currency_code_encoded is None) is filled
        assert (row.country_code_indexed is None) is filled


def test_months_before_the_first_sale_are_filled(transactions):
    df = transactions(("a", [month("2023-01")], [1]), ("b", [month("2023-04")], [2]))
    assert as_dict(continuous_series(df).where("anonymous_uu_id = 'b'")) == {
        ("b", m): (2.0 if m == month("2023-04") else 0.0) for m in months("2023-01", 4)
    }


def test_duplicates_are_summed_and_the_larger_code_is_kept(spark):
    jan = month("2023-01")
    df = spark.createDataFrame(
        [
            ("m", "USD", "US", jan, 10.0, 1),
            ("m", "EUR", "FR", jan, 8.0, 1),
            ("m", "EUR", "FR", datetime.date(2023, 1, 20), 7.0, 1),
            ("tie", "USD", "US", jan, 5.0, 1),
            ("tie", "EUR", "FR", jan, 5.0, 1),
            ("tie", None, None, jan, 5.0, 1),
        ],
        TRANSACTIONS,
    )
    got = {
        r.anonymous_uu_id: (r.sales_amount_actual, r.currency_code, r.country_code)
        for r in continuous_series(df).collect()
    }
    assert got == {"m": (25.0, "EUR", "FR"), "tie": (15.0, "EUR", "FR")}


def test_merchants_without_months_stay_and_rows_without_merchant_go(spark):
    df = spark.createDataFrame(
        [
            ("known", "USD", "US", month("2023-01"), 1.0, 1),
            ("known", "USD", "US", None, 100.0, 1),
            ("known", "USD", "US", month("2023-03"), 2.0, 1),
            ("only_null", "USD", "US", None, 5.0, 1),
            ("only_null", "EUR", "FR", None, 6.0, 1),
            (None, "USD", "US", month("2023-02"), 7.0, 1),
        ],
        TRANSACTIONS,
    )
    assert as_dict(continuous_series(df)) == {
        ("known", month("2023-01")): 1.0,
        ("known", month("2023-02")): 0.0,
        ("known", month("2023-03")): 2.0,
        ("only_null", month("2023-01")): 0.0,
        ("only_null", month("2023-02")): 0.0,
        ("only_null", month("2023-03")): 0.0,
    }
    totals = {
        (r.anonymous_uu_id, r.transaction_month): r.sales_amount_actual
        for r in monthly_totals(df).collect()
    }
    assert totals == {
        ("known", month("2023-01")): 1.0,
        ("known", month("2023-03")): 2.0,
        ("known", None): 0.0,
        ("only_null", None): 0.0,
    }


def test_given_bounds_are_kept(spark, transactions):
    df = transactions(("m", months("2023-01", 6), [1, 2, 3, 4, 5, 6]))
    bounds = spark.createDataFrame(
        [(month("2023-03"), month("2023-05"))], "first_month date, last_month date"
    )
    assert as_dict(continuous_series(df, bounds)) == {
        ("m", month("2023-03")): 3.0,
        ("m", month("2023-04")): 4.0,
        ("m", month("2023-05")): 5.0,
    }


@pytest.mark.parametrize("name", ["sales_amount_actual", "sales_amount", None])
def test_optional_columns(spark, name):
    columns = "anonymous_uu_id string, transaction_month_dt date"
    row = ("m", month("2023-01"))
    if name:
        columns, row = f"{columns}, {name} double", (*row, 3.0)
    got = continuous_series(spark.createDataFrame([row], columns)).first()
    assert got.sales_amount_actual == (3.0 if name else 0.0)
    assert got.currency_code is None and got.country_code is None


def test_calendar(with_gap):
    got = month_calendar(month_bounds(with_gap)).collect()
    assert [r.transaction_month for r in got] == months("2023-01", 3)


def test_empty_input(spark):
    series = continuous_series(spark.createDataFrame([], TRANSACTIONS))
    assert series.count() == 0
    assert series.columns == [
        "anonymous_uu_id",
        "transaction_month",
        "sales_amount_actual",
        "currency_code",
        "country_code",
        "has_transactions",
    ]


@pytest.fixture(scope="module")
def random_sales(spark):
    rng = random.Random(5)
    calendar = months("2020-01", 40)
    sales = defaultdict(float)
    rows = []
    for k in range(40):
        for m in rng.sample(calendar, rng.randint(1, 30)):
            for _ in range(rng.randint(1, 3)):
                amount = float(rng.choice([0, 0, 25, 100, -25]))
                sales[f"m{k}", m] += amount
                rows.append((f"m{k}", "USD", "US", m, amount, 1))
    return sales, spark.createDataFrame(rows, TRANSACTIONS)


def test_against_brute_force(random_sales):
    sales, df = random_sales
    lo, hi = min(m for _, m in sales), max(m for _, m in sales)
    calendar = [m for m in months("2020-01", 40) if lo <= m <= hi]
    expected = {(f"m{k}", m): sales.get((f"m{k}", m), 0.0) for k in range(40) for m in calendar}
    got = continuous_series(df)
    assert as_dict(got) == expected
    assert got.agg(F.sum("sales_amount_actual")).first()[0] == sum(sales.values())


def test_streaks_against_brute_force(random_sales):
    sales, df = random_sales
    expected = set()
    for k in range(40):
        run = []
        for m in [*months("2020-01", 40), None]:
            if m is not None and sales.get((f"m{k}", m), 0) > 0:
                run.append(m)
            elif run:
                expected.add((f"m{k}", run[0], run[-1], len(run)))
                run = []
    assert {tuple(r) for r in positive_streaks(continuous_series(df)).collect()} == expected


def test_series_shuffles_twice_and_its_users_not_at_all(with_gap):
    """Once to sum by code, once by month, once by merchant; the calendar's own exchange is in a subquery."""
    streaks = positive_streaks(continuous_series(with_gap, month_bounds(with_gap)))
    plan = streaks._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    executed = streaks._jdf.queryExecution().executedPlan().toString()
    main = [line for line in executed.splitlines() if not line.lstrip().startswith(":")]
    assert sum("Exchange hashpartitioning" in line for line in main) == 3


def test_cancelled_months_have_no_sales(spark):
    rows = [("m", "USD", "US", month(f"2021-0{k}"), v, 1) for k, v in ((1, 5.0), (2, 0.1), (2, 0.2), (2, -0.3), (3, 7.0))]
    series = continuous_series(spark.createDataFrame(rows, TRANSACTIONS))
    assert [r.streak_months for r in positive_streaks(series).collect()] == [1, 1]


def test_merchants_are_dealt_out_before_they_become_their_months(spark, tmp_path):
    """However small the merchants' table is, no task has many of them."""
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'ASIA' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 'CHINA' AS n_name, 0 AS n_regionkey",
        "supplier": "SELECT id AS s_suppkey, 0 AS s_nationkey FROM range(300)",
        "customer": "SELECT id AS c_custkey, 0 AS c_nationkey, 'x' AS c_mktsegment FROM range(300)",
        "lineitem": "SELECT id AS l_suppkey, 10D AS l_extendedprice, 0D AS l_discount,"
        " timestamp_ntz'2020-01-15' + make_interval(0, int(id % 24)) AS l_shipdate FROM range(300)",
        "orders": "SELECT id AS o_orderkey, id AS o_custkey, 10D AS o_totalprice,"
        " timestamp_ntz'2020-01-15' + make_interval(0, int(id % 24)) AS o_orderdate FROM range(300)",
    }
    for name, query in tables.items():
        spark.sql(query).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    for rows, bounds, merchants in (
        (panels.planted_transactions, panels.supplier_bounds, 600),
        (panels.supplier_monthly, panels.supplier_bounds, 300),
        (panels.customer_monthly, panels.customer_bounds, 300),
    ):
        series = continuous_series(rows(spark, folder), bounds(spark, folder))
        tasks = series.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(t["count"] for t in tasks) == merchants * 24
        assert max(t["count"] for t in tasks) <= 24 * merchants / 20
