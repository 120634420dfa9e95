"""The star-schema test tables as merchant transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.months import month_start, months_between_inclusive
from tillcast.operators.series import by_merchant, calendar_ends, month_bounds
from tillcast.schema import CODES, MERCHANT, MONTH_DT, RAW_COUNT, RAW_MONTH, RAW_SALES


# The columns used, so that no file has to be opened to learn them.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_suppkey BIGINT, l_extendedprice DOUBLE, l_discount DOUBLE,"
    " l_shipdate TIMESTAMP_NTZ",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def to_cents(amount: Column) -> Column:
    """Amount in whole cents, half a cent up."""
    return F.floor(amount * 100 + 0.5)


def supplier_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as merchants: one row per line item, no codes."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _sales(read_table(spark, folder, "lineitem"), "l_suppkey", "l_shipdate", net)


def supplier_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as merchants: sales by month of shipping, with codes."""
    suppliers = read_table(spark, folder, "supplier")
    return by_merchant(_monthly(supplier_sales(spark, folder))).join(
        _codes(spark, folder, suppliers, "s_suppkey", "s_nationkey"), MERCHANT, "left"
    )


def supplier_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """First and last month of :func:`supplier_sales`, from one column."""
    return month_bounds(read_table(spark, folder, "lineitem"), "l_shipdate")


def customer_sales(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Customers as merchants: one row per order, no codes; with ``more`` columns of the orders."""
    orders = read_table(spark, folder, "orders")
    return _sales(orders, "o_custkey", "o_orderdate", F.col("o_totalprice"), *more)


def customer_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as merchants: sales by month of ordering, with codes."""
    return by_merchant(_monthly(customer_sales(spark, folder))).join(
        customer_codes(spark, folder), MERCHANT, "left"
    )


def customer_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """First and last month of :func:`customer_sales`, from one column."""
    return month_bounds(read_table(spark, folder, "orders"), "o_orderdate")


def customer_raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a raw text row, some fields of it spoilt by order key."""
    orders = read_table(spark, folder, "orders")

    def spoilt(every: int, bad: str | None, good: Column) -> Column:
        return F.when(F.col("o_orderkey") % every == 0, F.lit(bad)).otherwise(good)

    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").cast("string").alias("customer"),
        spoilt(23, "n/a", F.date_format("o_orderdate", "yyyyMM")).alias(RAW_MONTH),
        spoilt(17, "", F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias(RAW_SALES),
        spoilt(19, None, F.lit("1")).alias(RAW_COUNT),
        (F.col("o_orderkey") % 29 == 0).alias("anonymous"),
    ).join(
        customer_codes(spark, folder).withColumnRenamed(MERCHANT, "customer"),
        "customer",
        "left",
    ).select(
        "order_key",
        F.when(~F.col("anonymous"), F.col("customer")).alias(MERCHANT),
        *CODES,
        RAW_MONTH,
        RAW_SALES,
        RAW_COUNT,
    )


def _sales(rows: DataFrame, key: str, date: str, amount: Column, *more: str) -> DataFrame:
    return rows.select(
        F.col(key).cast("string").alias(MERCHANT),
        month_start(date).alias(MONTH_DT),
        (to_cents(amount) / 100.0).alias(RAW_SALES),
        *more,
    )


def _monthly(sales: DataFrame) -> DataFrame:
    """Sums before the join with the codes, so that no single rows are shuffled for it."""
    return sales.groupBy(MERCHANT, MONTH_DT).agg(
        F.sum(RAW_SALES).alias(RAW_SALES), F.count(F.lit(1)).alias(RAW_COUNT)
    )


def _codes(
    spark: SparkSession, folder: str, merchants: DataFrame, key: str, nation_key: str
) -> DataFrame:
    """Merchant id with its region as currency and its nation as country."""
    nations = read_table(spark, folder, "nation")
    regions = read_table(spark, folder, "region")
    return (
        merchants.join(nations, F.col(nation_key) == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col(key).cast("string").alias(MERCHANT),
            F.col("r_name").alias(CODES[0]),
            F.col("n_name").alias(CODES[1]),
        )
    )


def segment_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Market segments as merchants, one row per order.

    Very few merchants hold all rows, and each sells under many codes.
    """
    customers = read_table(spark, folder, "customer")
    segments = customers.select(
        F.col("c_custkey").cast("string").alias("customer"), F.col("c_mktsegment").alias("segment")
    )
    codes = customer_codes(spark, folder)
    places = segments.join(codes, F.col("customer") == F.col(MERCHANT)).drop(MERCHANT)
    return (
        read_table(spark, folder, "orders")
        .select(
            F.col("o_custkey").cast("string").alias("customer"),
            month_start("o_orderdate").alias(MONTH_DT),
            (to_cents(F.col("o_totalprice")) / 100.0).alias(RAW_SALES),
        )
        .join(places, "customer")
        .select(F.col("segment").alias(MERCHANT), *CODES, MONTH_DT, RAW_SALES)
    )


# Planted sales by the last month of a season, by region and by nation. Unequal steps, so
# that no two sums are the same.
SEASONS = ((3, 1000.0), (6, 2500.0), (9, 7000.0), (12, 20000.0))
REGION_STEPS = {"ASIA": 4000.0, "EUROPE": 1500.0}
NATION_STEPS = {"CHINA": 600.0, "FRANCE": 300.0}


def planted_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions whose sales follow a known rule with noise that no feature explains.

    Every supplier is two merchants, ``-a`` and ``-b``, which sell once in every month of the line
    items: an amount for the season, the region and the nation. In December one sells more and the other as
    much less, by an amount that depends on supplier and year. Both have the same features then, so the best
    that any model can do is the rule itself, and its error is the noise.
    """
    first, last = calendar_ends(supplier_bounds(spark, folder))
    suppliers = _codes(
        spark, folder, read_table(spark, folder, "supplier"), "s_suppkey", "s_nationkey"
    )
    twins = suppliers.select(
        F.col(MERCHANT).alias("supplier"),
        *CODES,
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("twin"),
    ).select("*", F.concat_ws("-", "supplier", "twin").alias(MERCHANT))
    # A merchant is one short row here: dealt out before it becomes all its months.
    rows = by_merchant(twins).select(
        "*", F.explode(months_between_inclusive(first, last)).alias(MONTH_DT)
    )

    season = F.lit(SEASONS[-1][1])
    for until, amount in reversed(SEASONS[:-1]):
        season = F.when(F.month(MONTH_DT) <= until, F.lit(amount)).otherwise(season)
    steps = season
    for code, amounts in zip(CODES, (REGION_STEPS, NATION_STEPS)):
        for name, amount in amounts.items():
            steps = steps + F.when(F.col(code) == name, F.lit(amount)).otherwise(F.lit(0.0))
    noise = (F.pmod(F.col("supplier").cast("bigint") * 7 + F.year(MONTH_DT), F.lit(11)) + 1) * 50.0
    signed = F.when(F.month(MONTH_DT) < 12, F.lit(0.0)).when(F.col("twin") == "a", noise)
    return rows.select(
        MERCHANT,
        *CODES,
        MONTH_DT,
        (steps + signed.otherwise(-noise)).alias(RAW_SALES),
    )


def customer_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with its codes."""
    customers = read_table(spark, folder, "customer")
    return _codes(spark, folder, customers, "c_custkey", "c_nationkey")
