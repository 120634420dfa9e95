from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(text: str) -> datetime.date:
    """`2023-01` to a date."""
    return datetime.date(int(text[:4]), int(text[5:7]), 1)


def months(first: str, count: int) -> list[datetime.date]:
    start = month(first)
    number = start.year * 12 + start.month - 1
    return [
        datetime.date((number + k) // 12, (number + k) % 12 + 1, 1) for k in range(count)
    ]


TRANSACTIONS = (
    "anonymous_uu_id string, currency_code string, country_code string,"
    " transaction_month_dt date, sales_amount double, transaction_count bigint"
)


@pytest.fixture(scope="session")
def transactions(spark):
    """Cleaned transactions from (merchant, months, amounts) runs, all in US dollars."""

    def build(*runs):
        rows = [
            (merchant, "USD", "US", m, float(amount), 1)
            for merchant, when, amounts in runs
            for m, amount in zip(when, amounts)
        ]
        return spark.createDataFrame(rows, TRANSACTIONS)

    return build


@pytest.fixture(scope="session")
def asof_panel(transactions):
    """Six merchants seen from June 2024; merchant_D has twelve rows in one month."""
    first = months("2023-01", 12)
    second = months("2024-01", 6)
    return transactions(
        ("merchant_A", first, [5500 + 50 * k for k in range(1, 13)]),
        ("merchant_A", second, [6000 + 100 * k for k in range(1, 7)]),
        ("merchant_B", second[:5], [6000 + 50 * k for k in range(1, 6)]),
        ("merchant_C", first, [300] * 12),
        ("merchant_C", second, [350] * 6),
        ("merchant_D", [month("2023-01")] * 12, [7000 - 100 * k for k in range(1, 13)]),
        ("merchant_D", second, [5000, 4800, 4500, 4000, 3500, 3000]),
        ("merchant_E", first + second, [6000] * 18),
        ("merchant_F", months("2023-01", 14), [6000, 6000, 0] + [6000] * 11),
    )
