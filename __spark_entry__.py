
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.lineage import scratch, shared_folder
from tillcast.operators.calendar import suspect_months
from tillcast.operators.cleaning import clean_transactions, rejected_transactions
from tillcast.operators.dictionary import (
    encode_with_dictionary,
    fit_dictionary,
    index_categories,
)
from tillcast.operators.eligibility import asof_features, judge_eligibility, windowed_eligibility
from tillcast.operators.encoding import encode_categories
from tillcast.operators.evaluation import (
    holdout_features,
    rmse,
    score_holdout,
    split_cutoff,
    temporal_split,
)
from tillcast.operators.features import model_features
from tillcast.operators.forecasting import (
    mean_forecast,
    mean_forecast_from_transactions,
    model_forecast,
    model_forecast_from_transactions,
)
from tillcast.operators.offers import (
    advance_amounts,
    lookup_forecasts,
    lookup_offers,
    score_offers,
)
from tillcast.operators.series import continuous_series, month_calendar
from tillcast.operators.streaks import positive_streaks
from tillcast.operators.training import (
    FULL_DEPTHS,
    FULL_TREES,
    assembled_examples,
    search_settings,
    train_forecaster,
)
from tillcast.plans.scoring import forecast_all, offers_from_transactions
from tillcast.schema import (
    CODES,
    HORIZON_MONTHS,
    MERCHANT,
    MONTH,
    PREDICTION,
    SALES,
    AdvancePolicy,
)
from tillcast.sources import panels
from tillcast.sources.tables import publish, read_published
from tillcast.sources.transactions import read_raw_transactions
from tillcast.streaming.requests import answer_requests, read_requests

try:  # both can be taken out of the repository together, and need modules that the rest does without
    import corpus_pipeline
    from tillcast.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name.startswith("tillcast") and not missing.name.startswith("tillcast.llm"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Offers for all suppliers."""
    return offers(spark, "/root/testdata/sf0.001")


# --- queries -----------------------------------------------------------------


def supplier_series(spark: SparkSession, folder: str) -> DataFrame:
    return continuous_series(
        panels.supplier_monthly(spark, folder), panels.supplier_bounds(spark, folder)
    )


def supplier_sales_series(spark: SparkSession, folder: str) -> DataFrame:
    """Without codes, for what does not use them."""
    return continuous_series(
        panels.supplier_sales(spark, folder), panels.supplier_bounds(spark, folder)
    )


def customer_sales_series(spark: SparkSession, folder: str) -> DataFrame:
    """Without codes, for what does not use them."""
    return continuous_series(
        panels.customer_sales(spark, folder), panels.customer_bounds(spark, folder)
    )


def customer_series(spark: SparkSession, folder: str) -> DataFrame:
    return continuous_series(
        panels.customer_monthly(spark, folder), panels.customer_bounds(spark, folder)
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Four decimals: sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, 4) for c in columns})


def monthly_sales(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(panels.supplier_monthly(spark, folder), "sales_amount")


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean_transactions(panels.customer_raw_text(spark, folder))


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_transactions(cleaned(spark, folder)).select("order_key", "reject_reason")


def rejected_by_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Against a calendar that lacks the last year of the orders."""
    bounds = panels.customer_bounds(spark, folder).select(
        "first_month", F.add_months("last_month", -12).alias("last_month")
    )
    return rejected_transactions(cleaned(spark, folder), bounds).select(
        "order_key", "reject_reason"
    )


def stray_months(spark: SparkSession, folder: str) -> DataFrame:
    """The orders, a few of them dated 0001-01, 9999-12 or three years after the last."""
    raw = panels.customer_raw_text(spark, folder)
    key = F.col("order_key")
    last = panels.customer_bounds(spark, folder).select("last_month").scalar()
    month = (
        F.when(key % 499 == 0, "000101")
        .when(key % 503 == 0, "999912")
        .when(key % 14983 == 0, F.date_format(F.add_months(last, 6), "yyyyMM"))
        .otherwise(F.col("transaction_month"))
    )
    return suspect_months(clean_transactions(raw.withColumn("transaction_month", month)))


def malformed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as text files, some of whose lines are no proper rows, read and reported."""
    place = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    month, price = F.date_format("o_orderdate", "yyyyMM"), F.col("o_totalprice").cast("decimal(18,2)")
    line = (
        F.when(key % 97 == 0, F.concat_ws(",", "o_custkey", F.lit("USD"), F.lit("US")))
        .when(key % 101 == 0, F.concat_ws(",", "o_custkey", F.lit("USD"), F.lit("US"), month, price, F.lit("1,1")))
        .when(key % 103 == 0, F.concat_ws(",", "o_custkey", F.lit('"U"SD'), F.lit("US"), month, price, F.lit("1")))
        .otherwise(F.concat_ws(",", "o_custkey", F.lit('"USD"'), F.lit("US"), month, price, F.lit("1")))
    )
    header = "anonymous_uu_id,currency_code,country_code,transaction_month,sales_amount,transaction_count"
    lines = panels.read_table(spark, folder, "orders").select(line.alias(header))
    lines.write.csv(place, header=True, quote="", escape="", sep="\x01")
    raw = read_raw_transactions(spark, place, report=True)
    return rejected_transactions(clean_transactions(raw)).select("malformed_line", "reject_reason")


def refunded_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every third order is paid back in its month: what remains may be nothing at all."""
    sales = panels.customer_sales(spark, folder, "o_orderkey")
    refunds = sales.where("o_orderkey % 3 = 0").withColumn("sales_amount", -F.col("sales_amount"))
    bounds = panels.customer_bounds(spark, folder)
    return positive_streaks(continuous_series(sales.unionByName(refunds), bounds))


def filled_series(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(customer_series(spark, folder), SALES)


def filled_series_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(continuous_series(cleaned(spark, folder)), SALES)


def filled_series_many_codes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(continuous_series(panels.segment_orders(spark, folder)), SALES)


def category_index(spark: SparkSession, folder: str) -> DataFrame:
    encoded, _ = encode_categories(panels.customer_codes(spark, folder))
    return encoded.select(
        MERCHANT, *[F.col(f"{c}_indexed").cast("bigint").alias(f"{c}_slot") for c in CODES]
    )


def category_index_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """As ``category_index``, by a table of labels."""
    codes = panels.customer_codes(spark, folder)
    labels = fit_dictionary(codes, f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}")
    return index_categories(codes, labels).select(
        MERCHANT, *[F.col(f"{c}_indexed").cast("bigint").alias(f"{c}_slot") for c in CODES]
    )


def order_category_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Customer and day of every order, categories with very many labels, as one-hot vectors."""
    orders = panels.read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request"),
        F.when(F.col("o_orderkey") % 31 != 0, F.col("o_custkey")).alias("customer"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
    )
    place = shared_folder(spark)
    labels = fit_dictionary(orders, f"{place}/labels-{uuid.uuid4().hex}", ("customer", "day"))
    encoded = encode_with_dictionary(orders, labels, place)
    vectors = F.array(
        *[F.struct(F.lit(c).alias("code"), F.unwrap_udt(f"{c}_encoded").alias("v")) for c in ("customer", "day")]
    )
    return encoded.select("request", F.inline(vectors)).select(
        "request",
        "code",
        F.col("v.size").cast("bigint").alias("width"),
        F.try_element_at("v.indices", F.lit(1)).cast("bigint").alias("slot"),
        F.coalesce(F.try_element_at("v.values", F.lit(1)), F.lit(0.0)).alias("value"),
    )


def category_onehot(spark: SparkSession, folder: str) -> DataFrame:
    encoded, _ = encode_categories(panels.customer_codes(spark, folder))
    vectors = [
        F.struct(F.lit(c).alias("code"), vector_to_array(f"{c}_encoded").alias("vector"))
        for c in CODES
    ]
    return (
        encoded.select(MERCHANT, F.inline(F.array(*vectors)))
        .select(MERCHANT, "code", F.posexplode("vector").alias("slot", "value"))
        .where("value = 1")
        .select(MERCHANT, "code", F.col("slot").cast("bigint").alias("slot"))
    )


def streaks(spark: SparkSession, folder: str) -> DataFrame:
    return positive_streaks(customer_sales_series(spark, folder))


def windowed(series: Query) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(
            windowed_eligibility(series(spark, folder)),
            "avg_sales_last_12_months",
            "sales_trend_score",
        )

    return query


def supplier_features(spark: SparkSession, folder: str) -> DataFrame:
    as_of = panels.supplier_bounds(spark, folder).select("last_month")
    return asof_features(supplier_sales_series(spark, folder), as_of)


def customer_features(spark: SparkSession, folder: str) -> DataFrame:
    as_of = panels.customer_bounds(spark, folder).select("last_month")
    return asof_features(customer_sales_series(spark, folder), as_of)


def asof(features: Query) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(
            features(spark, folder),
            "avg_sales_last_12_months",
            "avg_sales_recent_3_months",
            "avg_sales_prior_3_months",
        )

    return query


def verdict(spark: SparkSession, folder: str) -> DataFrame:
    return judge_eligibility(supplier_features(spark, folder))


def features_for_model(include_current: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        features = model_features(customer_series(spark, folder), include_current)
        return rounded(
            features.drop("has_transactions"),
            SALES,
            "sales_lag_1",
            "sales_lag_2",
            "sales_lag_3",
            "ma_3_months",
            "ma_6_months",
        )

    return query


def supplier_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return mean_forecast(supplier_sales_series(spark, folder), jitter=0.0)


def forecast(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(supplier_forecast(spark, folder), PREDICTION)


def supplier_forecast_direct(spark: SparkSession, folder: str) -> DataFrame:
    return mean_forecast_from_transactions(
        panels.supplier_sales(spark, folder), panels.supplier_bounds(spark, folder), jitter=0.0
    )


def forecast_direct(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(supplier_forecast_direct(spark, folder), PREDICTION)


def forecast_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Six decimals: a cent over 80 months ends exactly there, four would be a tie."""
    forecasts = forecast_all(panels.customer_raw_text(spark, folder), jitter=0.0)
    return forecasts.withColumn(PREDICTION, F.round(PREDICTION, 6))


def jittered_forecast(spark: SparkSession, folder: str) -> DataFrame:
    series = supplier_sales_series(spark, folder)
    return mean_forecast(series, jitter=0.05, seed=7).withColumn(PREDICTION, F.round(PREDICTION, 4))


def amounts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(advance_amounts(supplier_forecast_direct(spark, folder)), "advance_amount")


def supplier_offers(spark: SparkSession, folder: str) -> DataFrame:
    return offers_from_transactions(
        panels.supplier_sales(spark, folder), panels.supplier_bounds(spark, folder), jitter=0.0
    )


# Customers buy too seldom for the ordinary rules.
LENIENT = AdvancePolicy(min_streak_months=1, min_recent_to_prior=0.5)


def offers(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(supplier_offers(spark, folder), "advance_amount")


def offers_from_series(spark: SparkSession, folder: str) -> DataFrame:
    as_of = panels.supplier_bounds(spark, folder).select("last_month")
    scored = score_offers(supplier_sales_series(spark, folder), as_of=as_of, jitter=0.0)
    return rounded(scored, "advance_amount")


def offers_sparse(spark: SparkSession, folder: str) -> DataFrame:
    scored = offers_from_transactions(
        panels.customer_sales(spark, folder),
        panels.customer_bounds(spark, folder),
        jitter=0.0,
        policy=LENIENT,
    )
    return rounded(scored, "advance_amount")


def order_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every order asks for the merchant numbered like its customer; many are unknown."""
    return panels.read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request"), F.col("o_custkey").cast("string").alias(MERCHANT)
    )


def forecast_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return by_month(
        lookup_forecasts(order_requests(spark, folder), supplier_forecast_direct(spark, folder))
    )


def by_month(answers: DataFrame) -> DataFrame:
    months = {
        f"forecast_{k}": F.round(F.get("forecasted_sales", F.lit(k - 1)), 4)
        for k in range(1, HORIZON_MONTHS + 1)
    }
    return answers.withColumns(months).drop("forecasted_sales")


def offer_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return offer_answers(lookup_offers(order_requests(spark, folder), supplier_offers(spark, folder)))


def offer_answers(answers: DataFrame) -> DataFrame:
    return rounded(answers, "advance_amount").select(
        "request",
        MERCHANT,
        "found",
        F.coalesce("is_eligible", F.lit(False)).alias("is_eligible"),
        "advance_amount",
    )


def offers_for_requests(spark: SparkSession, folder: str) -> DataFrame:
    """As ``offer_lookup``, but only the merchants asked for are worked out."""
    answers = offers_from_transactions(
        panels.supplier_sales(spark, folder),
        panels.supplier_bounds(spark, folder),
        order_requests(spark, folder),
        jitter=0.0,
    )
    return offer_answers(answers)


def published_forecast_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """As ``forecast_lookup``, from a published table and only those of its files that are needed."""
    requests = order_requests(spark, folder)
    path = publish(supplier_forecast_direct(spark, folder), shared_folder(spark))
    return by_month(lookup_forecasts(requests, read_published(spark, path, requests)))


def streamed_offer_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """As ``offer_lookup``, by a stream of requests that is answered in several batches."""
    place = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    order_requests(spark, folder).repartition(6, "request").write.json(f"{place}/requests")
    path = publish(supplier_offers(spark, folder), place)
    answer_requests(
        read_requests(spark, f"{place}/requests", 3, "request BIGINT"),
        path,
        lookup_offers,
        f"{place}/answers",
        f"{place}/state",
    ).awaitTermination()
    fields = f"request BIGINT, {MERCHANT} STRING, found BOOLEAN, is_eligible BOOLEAN, advance_amount DOUBLE"
    return offer_answers(spark.read.schema(fields).json(f"{place}/answers"))


def split_supplier_sales(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    calendar = month_calendar(panels.supplier_bounds(spark, folder))
    return temporal_split(supplier_sales_series(spark, folder), cutoff=split_cutoff(calendar))


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    train, test = split_supplier_sales(spark, folder)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("side"),
            F.count(F.lit(1)).alias("row_count"),
            F.min(MONTH).alias("first_month"),
            F.max(MONTH).alias("last_month"),
        )

    return side(train, "train").unionByName(side(test, "test"))


def naive_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """Error of the training mean on the test months."""
    train, test = split_supplier_sales(spark, folder)
    means = mean_forecast(train, horizon=1, jitter=0.0).select(MERCHANT, PREDICTION)
    return rounded(rmse(test.join(means, MERCHANT)), "rmse")


# A stand-in for the regressor that SQL can repeat. The divisors keep results
# from ending in a 5 that rounding could send either way.
RULE = (
    "sales_lag_1 / 1.1 - sales_lag_2 / 2.3 + sales_lag_3 / 4.7 + ma_3_months / 1.9"
    " - ma_6_months / 3.7 + 1000.0 * (month_of_year - 6) + (year - 2000)"
    " - 10 * length(country_code)"
)


def rule_model() -> PipelineModel:
    rule = SQLTransformer(statement=f"SELECT *, {RULE} AS {PREDICTION} FROM __THIS__")
    return PipelineModel(stages=[rule])


def recursive_forecast(include_current: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        forecasts = model_forecast(
            customer_series(spark, folder), rule_model(), include_current=include_current
        )
        return rounded(forecasts, PREDICTION)

    return query


def recursive_forecast_direct(spark: SparkSession, folder: str) -> DataFrame:
    forecasts = model_forecast_from_transactions(
        panels.customer_monthly(spark, folder),
        rule_model(),
        panels.customer_bounds(spark, folder),
    )
    return rounded(forecasts, PREDICTION)


# --- training on sales that follow a planted rule ------------------------------------

#: The time of the search in ``planted_model`` is bounded: fits end when held-out errors no longer change.
FLAT = 1e-12


def planted_series(spark: SparkSession, folder: str) -> DataFrame:
    return continuous_series(
        panels.planted_transactions(spark, folder), panels.supplier_bounds(spark, folder)
    )


def by_year() -> Column:
    """Three folds with all merchants in each, both of a supplier with the same months."""
    return (F.year(MONTH) % 3).cast("int")


def planted_model(series: DataFrame) -> PipelineModel:
    """The whole search, four settings and three folds."""
    return train_forecaster(
        series,
        FULL_DEPTHS,
        FULL_TREES,
        parallelism=4,
        include_current=False,
        fold=by_year(),
        min_gain=1e-6,
        tolerance=FLAT,
    )


def model_search(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out error of all four settings, and which one is chosen. Every fit has all its trees.

    The six fits, two depths and three folds, run at the same time.
    """
    with scratch(spark) as place:
        examples, _ = assembled_examples(
            planted_series(spark, folder), None, False, by_year(), place
        )
        found = search_settings(examples, FULL_DEPTHS, FULL_TREES, parallelism=6, min_gain=1e-6)
    rows = [(s.depth, s.trees, round(s.rmse, 2), s.chosen) for s in found]
    return spark.createDataFrame(rows, "max_depth int, trees int, rmse double, chosen boolean")


def trained_forecast(spark: SparkSession, folder: str) -> DataFrame:
    series = planted_series(spark, folder)
    forecasts = model_forecast(series, planted_model(series), include_current=False)
    return forecasts.withColumn(PREDICTION, F.round(PREDICTION, 2))


def trained_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """Error on the test months, by features that start anew there and that look back."""
    train, test = temporal_split(
        planted_series(spark, folder),
        cutoff=split_cutoff(month_calendar(panels.supplier_bounds(spark, folder))),
    )
    model = planted_model(train)

    def scored(name: str, history: DataFrame | None) -> DataFrame:
        rows = score_holdout(model, test, include_current=False, history=history)
        error = rmse(rows).select(F.round("rmse", 2)).scalar()
        return rows.agg(
            F.lit(name).alias("features"), F.count(F.lit(1)).alias("row_count"), error.alias("rmse")
        )

    return scored("restart", None).unionByName(scored("across", train))


def features_across(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the test months that look back over the cutoff."""
    train, test = temporal_split(
        customer_series(spark, folder),
        cutoff=split_cutoff(month_calendar(panels.customer_bounds(spark, folder))),
    )
    return rounded(
        holdout_features(test, include_current=True, history=train).drop("has_transactions"),
        SALES,
        "sales_lag_1",
        "sales_lag_2",
        "sales_lag_3",
        "ma_3_months",
        "ma_6_months",
    )


def queries() -> dict[str, Query]:
    return {
        "monthly_sales": monthly_sales,
        "clean_transactions": cleaned,
        "rejected_transactions": rejected,
        "rejected_by_calendar": rejected_by_calendar,
        "suspect_months": stray_months,
        "malformed_lines": malformed_lines,
        "refunded_streaks": refunded_streaks,
        "continuous_series": filled_series,
        "continuous_series_dirty": filled_series_dirty,
        "continuous_series_many_codes": filled_series_many_codes,
        "category_index": category_index,
        "category_onehot": category_onehot,
        "category_index_by_table": category_index_by_table,
        "order_category_vectors": order_category_vectors,
        "positive_streaks": streaks,
        "eligibility_windowed": windowed(supplier_sales_series),
        "eligibility_windowed_sparse": windowed(customer_sales_series),
        "eligibility_asof": asof(supplier_features),
        "eligibility_asof_sparse": asof(customer_features),
        "eligibility_verdict": verdict,
        "model_features": features_for_model(include_current=True),
        "model_features_known_only": features_for_model(include_current=False),
        "mean_forecast": forecast,
        "mean_forecast_direct": forecast_direct,
        "mean_forecast_dirty": forecast_dirty,
        "jittered_forecast": jittered_forecast,
        "advance_amounts": amounts,
        "offers": offers,
        "offers_from_series": offers_from_series,
        "offers_sparse": offers_sparse,
        "forecast_lookup": forecast_lookup,
        "offer_lookup": offer_lookup,
        "offers_for_requests": offers_for_requests,
        "published_forecast_lookup": published_forecast_lookup,
        "streamed_offer_lookup": streamed_offer_lookup,
        "temporal_split": split_sizes,
        "naive_rmse": naive_rmse,
        "recursive_forecast": recursive_forecast(include_current=True),
        "recursive_forecast_known_only": recursive_forecast(include_current=False),
        "recursive_forecast_direct": recursive_forecast_direct,
        "model_search": model_search,
        "model_forecast": trained_forecast,
        "model_holdout_rmse": trained_rmse,
        "holdout_features_across": features_across,
    } | ({**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {})


# --- the same in SQL -----------------------------------------------------------


def _with(ctes: dict[str, str], select: str) -> str:
    parts = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in ctes.items())
    return f"WITH {parts}\n{select}"


def _codes_sql(table: str, key: str, nation: str) -> str:
    return f"""
SELECT CAST({key} AS VARCHAR) AS anonymous_uu_id, r_name AS currency_code, n_name AS country_code
FROM {table} JOIN nation ON {nation} = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _monthly_sql(table: str, key: str, date: str, amount: str) -> str:
    return f"""
SELECT m.*, currency_code, country_code
FROM (
  SELECT CAST({key} AS VARCHAR) AS anonymous_uu_id,
         CAST(date_trunc('month', {date}) AS DATE) AS transaction_month_dt,
         CAST(sum(CAST(floor({amount} * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 100
           AS sales_amount,
         count(*) AS transaction_count
  FROM {table} GROUP BY 1, 2
) m LEFT JOIN codes USING (anonymous_uu_id)"""


SUPPLIER = {
    "codes": _codes_sql("supplier", "s_suppkey", "s_nationkey"),
    "panel": _monthly_sql(
        "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice * (1 - l_discount)"
    ),
}
CUSTOMER = {
    "codes": _codes_sql("customer", "c_custkey", "c_nationkey"),
    "panel": _monthly_sql("orders", "o_custkey", "o_orderdate", "o_totalprice"),
}
DIRTY = {
    "codes": CUSTOMER["codes"],
    "raw_text": """
SELECT o_orderkey AS order_key,
       CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS anonymous_uu_id,
       currency_code, country_code,
       CASE WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y%m') END
         AS transaction_month,
       CASE WHEN o_orderkey % 17 = 0 THEN ''
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS sales_amount,
       CASE WHEN o_orderkey % 19 <> 0 THEN '1' END AS transaction_count
FROM orders LEFT JOIN codes c ON c.anonymous_uu_id = CAST(o_custkey AS VARCHAR)""",
    "panel": """
SELECT * REPLACE (
         coalesce(TRY_CAST(sales_amount AS DOUBLE), 0) AS sales_amount,
         coalesce(TRY_CAST(transaction_count AS BIGINT), 0) AS transaction_count),
       CAST(try_strptime(transaction_month, '%Y%m') AS DATE) AS transaction_month_dt
FROM raw_text""",
}
SEGMENTS = {
    "codes": CUSTOMER["codes"],
    "panel": """
SELECT c_mktsegment AS anonymous_uu_id, currency_code, country_code,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS transaction_month_dt,
       floor(o_totalprice * 100 + CAST(0.5 AS DOUBLE)) / 100 AS sales_amount
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN codes ON anonymous_uu_id = CAST(c_custkey AS VARCHAR)""",
}

SERIES = {
    "bounds": """
SELECT min(transaction_month_dt) AS lo, max(transaction_month_dt) AS hi FROM panel""",
    "months": """
SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS transaction_month
FROM bounds""",
    "merchants": """
SELECT DISTINCT anonymous_uu_id FROM panel WHERE anonymous_uu_id IS NOT NULL""",
    "by_code": """
SELECT anonymous_uu_id, transaction_month_dt, currency_code, country_code,
       sum(sales_amount) AS sales
FROM panel GROUP BY ALL""",
    "ranked": """
SELECT *, sum(sales) OVER (PARTITION BY anonymous_uu_id, transaction_month_dt) AS total,
       row_number() OVER (PARTITION BY anonymous_uu_id, transaction_month_dt
                          ORDER BY sales DESC, currency_code NULLS LAST,
                                   country_code NULLS LAST) AS place
FROM by_code""",
    "series": """
SELECT m.anonymous_uu_id, transaction_month, coalesce(total, 0.0) AS sales_amount_actual,
       currency_code, country_code, total IS NOT NULL AS has_transactions
FROM merchants m CROSS JOIN months
LEFT JOIN ranked r ON r.anonymous_uu_id = m.anonymous_uu_id
                  AND transaction_month_dt = transaction_month AND place = 1""",
}

STREAKS = {
    "runs": """
SELECT anonymous_uu_id, transaction_month,
       year(transaction_month) * 12 + month(transaction_month)
         - row_number() OVER (PARTITION BY anonymous_uu_id ORDER BY transaction_month) AS run
FROM series WHERE sales_amount_actual > 0""",
    "streaks": """
SELECT anonymous_uu_id, min(transaction_month) AS streak_start,
       max(transaction_month) AS streak_end, count(*) AS streak_months
FROM runs GROUP BY anonymous_uu_id, run""",
}

ASOF = {
    **STREAKS,
    "latest": """
SELECT anonymous_uu_id, arg_max(streak_months, streak_end) AS streak
FROM streaks GROUP BY anonymous_uu_id""",
    "ranges": """
SELECT anonymous_uu_id,
       avg(sales_amount_actual) FILTER (transaction_month >= hi - INTERVAL 12 MONTH) AS a12,
       count(*) FILTER (transaction_month >= hi - INTERVAL 12 MONTH
                        AND sales_amount_actual > 0) AS n12,
       avg(sales_amount_actual) FILTER (transaction_month >= hi - INTERVAL 3 MONTH) AS recent,
       avg(sales_amount_actual) FILTER (transaction_month >= hi - INTERVAL 6 MONTH
                                        AND transaction_month < hi - INTERVAL 3 MONTH) AS prior
FROM series CROSS JOIN bounds GROUP BY anonymous_uu_id""",
    "features": """
SELECT anonymous_uu_id, a12 AS avg_sales_last_12_months, n12 AS months_in_last_12_with_sales,
       recent AS avg_sales_recent_3_months, prior AS avg_sales_prior_3_months,
       coalesce(streak, 0) AS latest_consecutive_months_with_sales
FROM ranges LEFT JOIN latest USING (anonymous_uu_id)""",
    "verdicts": """
SELECT *, is_sufficient_history AND meets_min_avg_sales AND has_stable_or_positive_trend
         AS is_eligible
FROM (
  SELECT anonymous_uu_id,
         latest_consecutive_months_with_sales >= 12 AS is_sufficient_history,
         avg_sales_last_12_months >= 5000 AS meets_min_avg_sales,
         CASE WHEN avg_sales_prior_3_months = 0 THEN avg_sales_recent_3_months > 0
              ELSE avg_sales_recent_3_months >= avg_sales_prior_3_months * CAST(0.95 AS DOUBLE)
         END AS has_stable_or_positive_trend
  FROM features)""",
}

FORECAST = {
    "means": """
SELECT anonymous_uu_id, avg(sales_amount_actual) AS mean, max(transaction_month) AS latest
FROM series GROUP BY anonymous_uu_id""",
    "forecasts": """
SELECT anonymous_uu_id, CAST(latest + to_months(CAST(k AS INTEGER)) AS DATE) AS transaction_month,
       greatest(mean, 0) AS prediction
FROM means CROSS JOIN range(1, 7) t(k)""",
    "amounts": """
SELECT anonymous_uu_id, sum(prediction) * 0.10 / 1.15 AS advance_amount
FROM forecasts GROUP BY anonymous_uu_id""",
}

OFFERS = {
    **FORECAST,
    "offers": """
SELECT v.*, CASE WHEN is_eligible THEN advance_amount ELSE 0.0 END AS advance_amount
FROM verdicts v JOIN amounts USING (anonymous_uu_id)""",
}

SPLIT = {
    "ordered": """
SELECT transaction_month, row_number() OVER (ORDER BY transaction_month) AS place,
       count(*) OVER () AS total
FROM (SELECT DISTINCT transaction_month FROM series)""",
    "cutoff": """
SELECT transaction_month AS cut FROM ordered
WHERE place = total - greatest(CAST(floor(total * 0.30) AS BIGINT), 1) + 1""",
}

WINDOWED_SQL = """
SELECT anonymous_uu_id, consecutive_months_sales,
       round(a12, 4) AS avg_sales_last_12_months, round(trend, 4) AS sales_trend_score,
       consecutive_months_sales >= 12 AS has_sufficient_history,
       a12 >= 5000 AS meets_min_avg_sales, trend >= -0.05 AS has_positive_trend
FROM (
  SELECT *, CASE WHEN prior > 0 THEN (recent - prior) / prior ELSE 0.0 END AS trend
  FROM (
    SELECT anonymous_uu_id, transaction_month,
           max(transaction_month) OVER (PARTITION BY anonymous_uu_id) AS latest,
           CAST(CASE WHEN sales_amount_actual > 0
                THEN count(*) OVER (PARTITION BY anonymous_uu_id, stretch
                                    ORDER BY transaction_month) - (CASE WHEN stretch > 0
                                    THEN 1 ELSE 0 END)
                ELSE 0 END AS BIGINT) AS consecutive_months_sales,
           avg(sales_amount_actual) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS a12,
           avg(sales_amount_actual) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
           avg(sales_amount_actual) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS prior
    FROM (
      SELECT *, count(*) FILTER (sales_amount_actual <= 0)
                  OVER (PARTITION BY anonymous_uu_id ORDER BY transaction_month) AS stretch
      FROM series)
    WINDOW w AS (PARTITION BY anonymous_uu_id ORDER BY transaction_month)
  )
) WHERE transaction_month = latest"""

ASOF_SQL = """
SELECT * REPLACE (round(avg_sales_last_12_months, 4) AS avg_sales_last_12_months,
                  round(avg_sales_recent_3_months, 4) AS avg_sales_recent_3_months,
                  round(avg_sales_prior_3_months, 4) AS avg_sales_prior_3_months)
FROM features"""


def _features_sql(last: int) -> str:
    end = "CURRENT ROW" if last == 0 else "1 PRECEDING"
    return f"""
SELECT anonymous_uu_id, transaction_month, round(sales_amount_actual, 4) AS sales_amount_actual,
       currency_code, country_code, round(l1, 4) AS sales_lag_1, round(l2, 4) AS sales_lag_2,
       round(l3, 4) AS sales_lag_3, round(m3, 4) AS ma_3_months, round(m6, 4) AS ma_6_months,
       CAST(month(transaction_month) AS INTEGER) AS month_of_year,
       CAST(year(transaction_month) AS INTEGER) AS year
FROM (
  SELECT *, lag(sales_amount_actual, 1) OVER w AS l1, lag(sales_amount_actual, 2) OVER w AS l2,
         lag(sales_amount_actual, 3) OVER w AS l3,
         avg(sales_amount_actual) OVER (w ROWS BETWEEN {2 - last} PRECEDING AND {end}) AS m3,
         avg(sales_amount_actual) OVER (w ROWS BETWEEN {5 - last} PRECEDING AND {end}) AS m6
  FROM series WINDOW w AS (PARTITION BY anonymous_uu_id ORDER BY transaction_month)
) WHERE has_transactions AND l3 IS NOT NULL"""


def _recursive_sql(include_current: bool) -> str:
    """The rule applied six times; h0 is the latest known month, h1 the one before."""
    n3, n6 = (2, 5) if include_current else (3, 6)
    ctes = dict(CUSTOMER | SERIES)
    ctes["aged"] = """
SELECT *, row_number() OVER (PARTITION BY anonymous_uu_id ORDER BY transaction_month DESC) - 1
         AS age
FROM series"""
    known = ", ".join(
        f"max(sales_amount_actual) FILTER (age = {k}) AS h{k}" for k in range(6)
    )
    ctes["step_0"] = f"""
SELECT anonymous_uu_id, max(transaction_month) AS latest,
       arg_max(country_code, transaction_month) FILTER (country_code IS NOT NULL) AS country_code,
       {known}
FROM aged GROUP BY anonymous_uu_id"""
    for step in range(1, 7):

        def past(k: int) -> str:
            back = k - (step - 1)
            return f"h{back}" if back >= 0 else f"f{-back}"

        def mean(n: int) -> str:
            return f"(({' + '.join(past(k) for k in range(n))}) / {n})"

        rule = RULE
        for name, value in {
            "sales_lag_1": past(0),
            "sales_lag_2": past(1),
            "sales_lag_3": past(2),
            "ma_3_months": mean(n3),
            "ma_6_months": mean(n6),
            "month_of_year": f"month(latest + INTERVAL {step} MONTH)",
            "(year ": f"(year(latest + INTERVAL {step} MONTH) ",
        }.items():
            rule = rule.replace(name, value)
        ctes[f"step_{step}"] = f"SELECT *, greatest({rule}, 0) AS f{step} FROM step_{step - 1}"
    rows = " UNION ALL ".join(
        f"SELECT anonymous_uu_id, CAST(latest + INTERVAL {k} MONTH AS DATE) AS transaction_month,"
        f" round(CAST(f{k} AS DOUBLE), 4) AS prediction FROM step_6"
        for k in range(1, 7)
    )
    return _with(ctes, rows)


def _slots_sql(code: str) -> str:
    return f"""
SELECT {code}, row_number() OVER (ORDER BY count(*) DESC, {code}) - 1 AS slot
FROM codes GROUP BY {code}"""


def _rule_sql() -> str:
    """What the planted rule gives for a merchant and month."""
    seasons = " ".join(f"WHEN month(transaction_month) <= {m} THEN {x}" for m, x in panels.SEASONS)
    steps = [f"CASE {seasons} END"]
    for code, amounts in zip(CODES, (panels.REGION_STEPS, panels.NATION_STEPS)):
        cases = " ".join(f"WHEN {code} = '{name}' THEN {x}" for name, x in amounts.items())
        steps.append(f"CASE {cases} ELSE 0 END")
    return "(" + " + ".join(steps) + ")"


PLANTED = {
    "bounds": """
SELECT date_trunc('month', min(l_shipdate)) AS lo, date_trunc('month', max(l_shipdate)) AS hi
FROM lineitem""",
    "merchants": f"""
SELECT s_suppkey AS supplier, twin, s_suppkey || '-' || twin AS anonymous_uu_id,
       currency_code, country_code
FROM supplier JOIN ({SUPPLIER["codes"]}) c ON c.anonymous_uu_id = CAST(s_suppkey AS VARCHAR)
CROSS JOIN (VALUES ('a'), ('b')) t(twin)""",
    "planted": """
SELECT *, CASE WHEN month(transaction_month) < 12 THEN 0
               ELSE CASE twin WHEN 'a' THEN 1 ELSE -1 END
                    * ((supplier * 7 + year(transaction_month)) % 11 + 1) * 50.0 END AS noise
FROM merchants CROSS JOIN (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS transaction_month
  FROM bounds)""",
}

SLOTS = {
    "codes": CUSTOMER["codes"],
    "currency_slots": _slots_sql("currency_code"),
    "country_slots": _slots_sql("country_code"),
}

REQUESTS = {
    "requests": """
SELECT o_orderkey AS request, CAST(o_custkey AS VARCHAR) AS anonymous_uu_id FROM orders""",
}


def oracle_sql() -> dict[str, str]:
    supplier, customer = SUPPLIER | SERIES, CUSTOMER | SERIES
    series_rows = "SELECT * REPLACE (round(sales_amount_actual, 4) AS sales_amount_actual) FROM series"
    forecast_columns = ", ".join(
        f"round(max(prediction) FILTER (transaction_month = latest + INTERVAL {k} MONTH), 4)"
        f" AS forecast_{k}"
        for k in range(1, 7)
    )
    found = {
        "monthly_sales": _with(
            SUPPLIER, "SELECT * REPLACE (round(sales_amount, 4) AS sales_amount) FROM panel"
        ),
        "clean_transactions": _with(DIRTY, "SELECT * FROM panel"),
        "rejected_transactions": _with(
            DIRTY,
            """
SELECT order_key, CASE WHEN anonymous_uu_id IS NULL THEN 'no merchant' ELSE 'no month' END
         AS reject_reason
FROM panel WHERE anonymous_uu_id IS NULL OR transaction_month_dt IS NULL""",
        ),
        "continuous_series": _with(customer, series_rows),
        "continuous_series_dirty": _with(DIRTY | SERIES, series_rows),
        "continuous_series_many_codes": _with(SEGMENTS | SERIES, series_rows),
        "category_index": _with(
            SLOTS,
            """
SELECT anonymous_uu_id, a.slot AS currency_code_slot, b.slot AS country_code_slot
FROM codes JOIN currency_slots a USING (currency_code) JOIN country_slots b USING (country_code)""",
        ),
        "category_onehot": _with(
            SLOTS,
            """
SELECT anonymous_uu_id, 'currency_code' AS code, slot
FROM codes JOIN currency_slots USING (currency_code)
UNION ALL
SELECT anonymous_uu_id, 'country_code', slot
FROM codes JOIN country_slots USING (country_code)""",
        ),
        "positive_streaks": _with(customer | STREAKS, "SELECT * FROM streaks"),
        "eligibility_windowed": _with(supplier, WINDOWED_SQL),
        "eligibility_windowed_sparse": _with(customer, WINDOWED_SQL),
        "eligibility_asof": _with(supplier | ASOF, ASOF_SQL),
        "eligibility_asof_sparse": _with(customer | ASOF, ASOF_SQL),
        "eligibility_verdict": _with(supplier | ASOF, "SELECT * FROM verdicts"),
        "model_features": _with(customer, _features_sql(last=0)),
        "model_features_known_only": _with(customer, _features_sql(last=-1)),
        "mean_forecast": _with(
            supplier | FORECAST,
            "SELECT * REPLACE (round(prediction, 4) AS prediction) FROM forecasts",
        ),
        "mean_forecast_direct": _with(
            supplier | FORECAST,
            "SELECT * REPLACE (round(prediction, 4) AS prediction) FROM forecasts",
        ),
        "mean_forecast_dirty": _with(
            DIRTY | SERIES | FORECAST,
            "SELECT * REPLACE (round(prediction, 6) AS prediction) FROM forecasts",
        ),
        "jittered_forecast": _with(
            supplier | FORECAST,
            """
SELECT anonymous_uu_id, transaction_month, round(greatest(0, prediction * (1 + 0.1 * (
         CAST('0x' || substr(md5(anonymous_uu_id || '|' || strftime(transaction_month, '%Y-%m-%d')
                                 || '|7'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)
         - CAST(0.5 AS DOUBLE)))), 4) AS prediction
FROM forecasts""",
        ),
        "advance_amounts": _with(
            supplier | FORECAST,
            "SELECT anonymous_uu_id, round(advance_amount, 4) AS advance_amount FROM amounts",
        ),
        "offers": _with(
            supplier | ASOF | OFFERS,
            "SELECT * REPLACE (round(advance_amount, 4) AS advance_amount) FROM offers",
        ),
        "offers_from_series": _with(
            supplier | ASOF | OFFERS,
            "SELECT * REPLACE (round(advance_amount, 4) AS advance_amount) FROM offers",
        ),
        "offers_sparse": _with(
            customer
            | ASOF
            | {"verdicts": ASOF["verdicts"].replace(">= 12 AS", ">= 1 AS").replace("0.95", "0.5")}
            | OFFERS,
            "SELECT * REPLACE (round(advance_amount, 4) AS advance_amount) FROM offers",
        ),
        "forecast_lookup": _with(
            supplier
            | FORECAST
            | REQUESTS
            | {
                "wide": f"""
SELECT anonymous_uu_id, {forecast_columns}
FROM forecasts JOIN means USING (anonymous_uu_id) GROUP BY anonymous_uu_id"""
            },
            """
SELECT r.request, r.anonymous_uu_id, w.anonymous_uu_id IS NOT NULL AS found,
       forecast_1, forecast_2, forecast_3, forecast_4, forecast_5, forecast_6
FROM requests r LEFT JOIN wide w ON r.anonymous_uu_id = w.anonymous_uu_id""",
        ),
        "offer_lookup": _with(
            supplier | ASOF | OFFERS | REQUESTS,
            """
SELECT r.request, r.anonymous_uu_id, o.anonymous_uu_id IS NOT NULL AS found,
       coalesce(is_eligible, false) AS is_eligible, round(advance_amount, 4) AS advance_amount
FROM requests r LEFT JOIN offers o ON r.anonymous_uu_id = o.anonymous_uu_id""",
        ),
        "offers_for_requests": _with(
            supplier | ASOF | OFFERS | REQUESTS,
            """
SELECT r.request, r.anonymous_uu_id, o.anonymous_uu_id IS NOT NULL AS found,
       coalesce(is_eligible, false) AS is_eligible, round(advance_amount, 4) AS advance_amount
FROM requests r LEFT JOIN offers o ON r.anonymous_uu_id = o.anonymous_uu_id""",
        ),
        "model_search": _with(
            PLANTED,
            """
SELECT CAST(depth AS INT) AS max_depth, CAST(trees AS INT) AS trees, round(avg(error), 2) AS rmse,
       depth = 5 AND trees = 300 AS chosen
FROM (
  SELECT year(transaction_month) % 3 AS fold, sqrt(avg(noise * noise)) AS error FROM planted
  WHERE transaction_month >= (SELECT lo + INTERVAL 3 MONTH FROM bounds) GROUP BY fold)
CROSS JOIN (VALUES (5), (10)) d(depth) CROSS JOIN (VALUES (300), (500)) t(trees)
GROUP BY depth, trees""",
        ),
        "model_forecast": _with(
            PLANTED,
            f"""
SELECT anonymous_uu_id, transaction_month, CAST({_rule_sql()} AS DOUBLE) AS prediction
FROM merchants CROSS JOIN (
  SELECT CAST(hi + to_months(CAST(k AS INTEGER)) AS DATE) AS transaction_month
  FROM bounds CROSS JOIN range(1, 7) t(k))""",
        ),
        "model_holdout_rmse": _with(
            PLANTED | {"series": "SELECT * FROM planted"} | SPLIT,
            """
SELECT features, count(*) AS row_count, round(sqrt(avg(noise * noise)), 2) AS rmse
FROM planted CROSS JOIN cutoff CROSS JOIN (VALUES ('restart', 3), ('across', 0)) f(features, lost)
WHERE transaction_month >= cut + to_months(CAST(lost AS INTEGER)) GROUP BY features""",
        ),
        "holdout_features_across": _with(
            customer | SPLIT,
            f"""
SELECT f.* FROM ({_features_sql(last=0)}) f CROSS JOIN cutoff WHERE transaction_month >= cut""",
        ),
        "suspect_months": _with(
            {
                "spoilt": """
SELECT CAST(o_custkey AS VARCHAR) AS customer,
       CAST(CASE WHEN o_orderkey % 499 = 0 THEN DATE '0001-01-01'
                 WHEN o_orderkey % 503 = 0 THEN DATE '9999-12-01'
                 WHEN o_orderkey % 14983 = 0
                   THEN date_trunc('month', (SELECT max(o_orderdate) FROM orders)) + INTERVAL 6 MONTH
                 WHEN o_orderkey % 23 <> 0 THEN date_trunc('month', o_orderdate) END AS DATE)
         AS transaction_month
FROM orders WHERE o_orderkey % 29 <> 0""",
                "support": """
SELECT transaction_month, count(*) AS row_count, count(DISTINCT customer) AS merchants,
       year(transaction_month) * 12 + month(transaction_month) AS number
FROM spoilt WHERE transaction_month IS NOT NULL GROUP BY transaction_month""",
                "spaced": """
SELECT *, number - lag(number) OVER (ORDER BY number) - 1 AS empty_before FROM support""",
                "runs": """
SELECT *, count(*) FILTER (empty_before > 12) OVER (ORDER BY number) AS run FROM spaced""",
                "main": """
SELECT run AS main_run, median(row_count) AS typical FROM runs GROUP BY run
ORDER BY sum(row_count) DESC, run LIMIT 1""",
            },
            """
SELECT transaction_month, row_count, merchants, CAST(empty_before AS INT) AS empty_before,
       CASE WHEN run <> main_run THEN 'beyond a gap' ELSE 'thin end' END AS reason
FROM (
  SELECT *, max(row_count) OVER (PARTITION BY run ORDER BY number) AS up_to,
         max(row_count) OVER (PARTITION BY run ORDER BY number DESC) AS from_on
  FROM runs) CROSS JOIN main
WHERE run <> main_run OR least(up_to, from_on) < typical * 0.01""",
        ),
        "malformed_lines": """
SELECT malformed_line, 'malformed line' AS reject_reason FROM (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_custkey || ',USD,US'
              WHEN o_orderkey % 101 = 0 THEN o_custkey || ',USD,US,' || month || ',' || price || ',1,1'
              WHEN o_orderkey % 103 = 0 THEN o_custkey || ',"U"SD,US,' || month || ',' || price || ',1'
         END AS malformed_line
  FROM (SELECT *, strftime(o_orderdate, '%Y%m') AS month, CAST(o_totalprice AS DECIMAL(18, 2)) AS price
        FROM orders))
WHERE malformed_line IS NOT NULL""",
        "order_category_vectors": """
WITH codes AS (
  SELECT o_orderkey AS request, 'customer' AS code,
         CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS label FROM orders
  UNION ALL
  SELECT o_orderkey, 'day', strftime(o_orderdate, '%Y%m%d') FROM orders
), slots AS (
  SELECT code, label, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, label) - 1 AS slot,
         count(*) OVER (PARTITION BY code) AS width
  FROM codes WHERE label IS NOT NULL GROUP BY code, label
), widths AS (
  SELECT code, any_value(width) AS width FROM slots GROUP BY code
)
SELECT request, code, widths.width, slot, CASE WHEN slot IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value
FROM codes JOIN widths USING (code) LEFT JOIN slots USING (code, label)""",
        "rejected_by_calendar": _with(
            DIRTY,
            """
SELECT order_key, CASE WHEN anonymous_uu_id IS NULL THEN 'no merchant'
                       WHEN transaction_month_dt IS NULL THEN 'no month'
                       ELSE 'month outside the calendar' END AS reject_reason
FROM panel
WHERE anonymous_uu_id IS NULL OR transaction_month_dt IS NULL
   OR transaction_month_dt > (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 12 MONTH
                              FROM orders)""",
        ),
        "refunded_streaks": _with(
            {
                "panel": """
SELECT CAST(o_custkey AS VARCHAR) AS anonymous_uu_id,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS transaction_month,
       sum(CASE WHEN o_orderkey % 3 = 0 THEN 0
                ELSE CAST(floor(o_totalprice * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) END)
         AS sales_amount_actual
FROM orders GROUP BY ALL""",
                "series": "SELECT * FROM panel",
            }
            | STREAKS,
            "SELECT * FROM streaks",
        ),
        "temporal_split": _with(
            supplier | SPLIT,
            """
SELECT CASE WHEN transaction_month < cut THEN 'train' ELSE 'test' END AS side,
       count(*) AS row_count, min(transaction_month) AS first_month,
       max(transaction_month) AS last_month
FROM series CROSS JOIN cutoff GROUP BY 1""",
        ),
        "naive_rmse": _with(
            supplier
            | SPLIT
            | {
                "trained": """
SELECT anonymous_uu_id, greatest(avg(sales_amount_actual), 0) AS mean
FROM series CROSS JOIN cutoff WHERE transaction_month < cut GROUP BY anonymous_uu_id"""
            },
            """
SELECT round(sqrt(avg(pow(sales_amount_actual - mean, 2))), 4) AS rmse
FROM series CROSS JOIN cutoff JOIN trained USING (anonymous_uu_id)
WHERE transaction_month >= cut""",
        ),
        "recursive_forecast": _recursive_sql(include_current=True),
        "recursive_forecast_known_only": _recursive_sql(include_current=False),
        "recursive_forecast_direct": _recursive_sql(include_current=True),
    }
    # The same results by another way.
    found["published_forecast_lookup"] = found["forecast_lookup"]
    found["streamed_offer_lookup"] = found["offer_lookup"]
    found["category_index_by_table"] = found["category_index"]
    return found | (llm.oracle_sql() if llm else {})
