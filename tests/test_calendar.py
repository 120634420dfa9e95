from __future__ import annotations

import pytest

from conftest import TRANSACTIONS, month, months
from tillcast.operators.calendar import month_support, require_plain_calendar, suspect_months
from tillcast.plans.preparation import series_from_raw


def rows_of(spark, counts):
    """So many rows, of two merchants by turns, in each month."""
    rows = [
        (f"m{k % 2}", "USD", "US", m, 1.0, 1) for m, n in counts for k in range(n)
    ]
    return spark.createDataFrame(rows, TRANSACTIONS)


def found(df, **settings):
    return {
        r.transaction_month: (r.row_count, r.merchants, r.empty_before, r.reason)
        for r in suspect_months(df, **settings).collect()
    }


PLAIN = [(m, 300) for m in months("2021-01", 24)]


def test_support(spark):
    df = rows_of(spark, [(month("2021-01"), 3), (month("2021-03"), 1)]).unionByName(
        spark.createDataFrame([(None, None, None, month("2021-03"), 1.0, 1), ("m1", None, None, None, 1.0, 1)], TRANSACTIONS)
    )
    assert sorted(month_support(df).collect()) == [(month("2021-01"), 3, 2), (month("2021-03"), 1, 1)]


def test_a_plain_calendar_has_no_suspects(spark):
    assert found(rows_of(spark, PLAIN)) == {}
    assert found(rows_of(spark, [(m, n) for m, n in PLAIN if m != month("2021-05")])) == {}  # a gap is no fault
    require_plain_calendar(rows_of(spark, PLAIN))
    assert found(spark.createDataFrame([], TRANSACTIONS)) == {}


def test_stray_dates_are_named(spark):
    df = rows_of(spark, [*PLAIN, (month("0001-01"), 1), (month("9999-12"), 2), (month("9999-11"), 400)])
    empty = (9999 * 12 + 11) - (2022 * 12 + 12) - 1
    assert found(df) == {
        month("0001-01"): (1, 1, None, "beyond a gap"),
        month("9999-11"): (400, 2, empty, "beyond a gap"),
        month("9999-12"): (2, 2, 0, "beyond a gap"),
    }


def test_thin_ends_are_named_and_thin_middles_are_not(spark):
    counts = [(m, 1 if k in (0, 1, 10, 23) else n) for k, (m, n) in enumerate(PLAIN)]
    assert {m: r[3] for m, r in found(rows_of(spark, counts)).items()} == {
        month("2021-01"): "thin end",
        month("2021-02"): "thin end",
        month("2022-12"): "thin end",
    }
    assert found(rows_of(spark, counts), thin_share=0.001) == {}


def test_the_gap_is_a_parameter(spark):
    df = rows_of(spark, [*PLAIN, (month("2023-04"), 300)])
    assert found(df) == {}
    assert found(df, max_gap=2) == {month("2023-04"): (300, 2, 3, "beyond a gap")}


def test_no_series_on_a_suspect_calendar(spark):
    raw = spark.createDataFrame(
        [("m", "USD", "US", "202301", "10", "1")] * 3 + [("m", "USD", "US", "999912", "1", "1"), ("m", "USD", "US", "000101", "1", "1")],
        "anonymous_uu_id string, currency_code string, country_code string,"
        " transaction_month string, sales_amount string, transaction_count string",
    )
    with pytest.raises(ValueError, match="0001-01-01 .1 rows, beyond a gap.*9999-12-01"):
        series_from_raw(raw, check_calendar=True)
    assert series_from_raw(raw.limit(1), check_calendar=True).count() == 1
