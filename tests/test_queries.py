"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", driver.oracle_sql())
def test_same_as_sql(spark, duck, name):
    df = driver.queries()[name](spark, str(FOLDER))
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted_rows(names, cursor.fetchall())
    assert expected
    assert sorted_rows(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", sorted(driver.queries().keys() - driver.oracle_sql().keys()))
def test_without_sql(spark, name):
    assert driver.queries()[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
