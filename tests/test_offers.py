from __future__ import annotations

import json
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from conftest import month, months
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
from tillcast.operators.series import continuous_series, month_bounds
from tillcast.plans.scoring import forecast_all, offers_from_transactions
from tillcast.sources.tables import needed_files, publish, read_manifest, read_published
from tillcast.streaming.requests import answer_batch, answer_requests, read_requests, write_answers

RATE = 0.10 / 1.15
FORECASTS = "anonymous_uu_id string, transaction_month date, prediction double"


def test_advance_amount(spark):
    forecasts = spark.createDataFrame(
        [("m", m, 10000.0) for m in months("2024-01", 6)], FORECASTS
    )
    assert advance_amounts(forecasts).first().advance_amount == pytest.approx(60000 * RATE)


def test_no_forecasts_no_advance(spark):
    none = spark.createDataFrame([], FORECASTS)
    merchants = spark.createDataFrame([("m",), ("m",)], "anonymous_uu_id string")
    assert advance_amounts(none).count() == 0
    assert [tuple(r) for r in advance_amounts(none, merchants).collect()] == [("m", 0.0)]


@pytest.fixture(scope="module")
def cleaned(transactions):
    first = months("2022-01", 12)
    return transactions(
        ("merchant_A", months("2022-01", 18), [8000 + 500 * k for k in range(18)]),
        ("merchant_B", [month("2023-05"), month("2023-06")], [1000, 1050]),
        ("merchant_C", first, [100] * 12),
        (
            "merchant_D",
            first,
            [10000, 9500, 9000, 8500, 8000, 7500, 5000, 4000, 3000, 2000, 1500, 1000],
        ),
    )


@pytest.fixture(scope="module")
def requests(spark):
    names = ["merchant_A", "merchant_B", "merchant_C", "merchant_D", "non_existent_merchant"]
    return spark.createDataFrame([(n,) for n in names], "anonymous_uu_id string")


def test_offers_end_to_end(cleaned, requests):
    mean = sum(8000 + 500 * k for k in range(18)) / 18
    for offers in (
        score_offers(continuous_series(cleaned), requests, jitter=0.0),
        offers_from_transactions(cleaned, requests=requests, jitter=0.0),
    ):
        got = {r.anonymous_uu_id: r for r in offers.collect()}
        assert len(got) == 5
        assert got["merchant_A"].is_eligible
        assert got["merchant_A"].advance_amount == pytest.approx(6 * mean * RATE)
        for name in "BCD":
            row = got[f"merchant_{name}"]
            assert row.found and not row.is_eligible and row.advance_amount == 0.0
        assert got["non_existent_merchant"].found is False
        assert got["non_existent_merchant"].advance_amount is None


def test_reasons(cleaned):
    got = {r.anonymous_uu_id: tuple(r)[1:4] for r in offers_from_transactions(cleaned).collect()}
    assert got == {
        "merchant_A": (True, True, True),
        "merchant_B": (False, False, True),
        "merchant_C": (True, False, False),
        "merchant_D": (True, False, False),
    }


def test_offer_is_the_advance_on_the_same_forecast(cleaned):
    series = continuous_series(cleaned)
    forecast = mean_forecast(series, jitter=0.05, seed=9)
    amounts = {r.anonymous_uu_id: r.advance_amount for r in advance_amounts(forecast).collect()}
    offer = score_offers(series, jitter=0.05, seed=9).where("is_eligible").first()
    assert offer.advance_amount == pytest.approx(amounts[offer.anonymous_uu_id])


def test_forecast_lookup(cleaned, requests):
    forecasts = mean_forecast(continuous_series(cleaned), seed=1)
    got = {r.anonymous_uu_id: r for r in lookup_forecasts(requests, forecasts).collect()}
    rows = forecasts.where("anonymous_uu_id = 'merchant_A'").orderBy("transaction_month").collect()
    assert got["merchant_A"].forecasted_sales == [r.prediction for r in rows]
    assert len(rows) == 6
    assert got["non_existent_merchant"].found is False
    assert got["non_existent_merchant"].forecasted_sales is None


def test_numbers_ask_for_names(spark):
    forecasts = spark.createDataFrame([("7", month("2024-01"), 1.5)], FORECASTS)
    asked = spark.createDataFrame([(7,), (8,), (None,)], "anonymous_uu_id bigint")
    found = {r.anonymous_uu_id: r.found for r in lookup_forecasts(asked, forecasts).collect()}
    assert {k if k is None else int(k): v for k, v in found.items()} == {
        7: True,
        8: False,
        None: False,
    }


def test_lookups_keep_every_request(spark, cleaned):
    asked = spark.createDataFrame(
        [(k, "merchant_A" if k % 3 else f"x{k}") for k in range(300)],
        "request int, anonymous_uu_id string",
    )
    found = lookup_offers(asked, offers_from_transactions(cleaned))
    assert found.count() == 300
    assert found.where("found").count() == 200


def test_a_merchant_asked_for_very_often_is_split(spark):
    """Shuffled join, one key with most rows: AQE splits it over several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        asked = spark.range(0, 200000, 1, 8).selectExpr(
            "id AS request", "if(id % 3 = 0, 'm0', concat('m', id % 1000)) AS anonymous_uu_id"
        )
        forecasts = spark.range(1000).selectExpr(
            "concat('m', id) AS anonymous_uu_id",
            "explode(sequence(date'2024-01-01', date'2024-06-01', interval 1 month))"
            " AS transaction_month",
            "double(id) AS prediction",
        )
        found = lookup_forecasts(asked, forecasts)
        assert found.where("found").count() == 200000
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_raw_to_forecast(spark):
    raw = spark.createDataFrame(
        [("m", "USD", "US", "202301", "10", "1"), ("m", "USD", "US", "202303", "", "1")],
        "anonymous_uu_id string, currency_code string, country_code string,"
        " transaction_month string, sales_amount string, transaction_count string",
    )
    rows = forecast_all(raw, horizon=2, jitter=0.0).orderBy("transaction_month").collect()
    assert [(r.transaction_month, r.prediction) for r in rows] == [
        (month("2023-04"), pytest.approx(10 / 3)),
        (month("2023-05"), pytest.approx(10 / 3)),
    ]


def test_streamed_requests(spark, tmp_path, cleaned):
    tables = publish(
        mean_forecast(continuous_series(cleaned), jitter=0.0), str(tmp_path / "forecasts")
    )
    inbox, outbox, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    answers = lookup_forecasts(read_requests(spark, str(inbox)), read_published(spark, tables))

    def serve():
        write_answers(answers, str(outbox), str(state)).awaitTermination()
        return {r.anonymous_uu_id: r for r in spark.read.json(str(outbox)).collect()}

    (inbox / "1.json").write_text('{"anonymous_uu_id": "merchant_A"}\n')
    assert len(serve()["merchant_A"].forecasted_sales) == 6
    (inbox / "2.json").write_text('{"anonymous_uu_id": "nobody"}\n')
    got = serve()
    assert set(got) == {"merchant_A", "nobody"} and got["nobody"].found is False


def test_earlier_versions_of_a_published_table_stay(spark, tmp_path, cleaned):
    offers = offers_from_transactions(cleaned, jitter=0.0)
    old = publish(offers.limit(1), str(tmp_path))
    new = publish(offers, str(tmp_path))
    assert sorted(read_published(spark, new).collect()) == sorted(offers.collect())
    assert read_published(spark, old).count() == 1


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Forecasts of 2,000 merchants, one of them with half of all rows, published in many files."""
    forecasts = spark.range(4000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("m"), F.col("id") * 7919 % 10007)).alias("anonymous_uu_id"),
        F.expr("add_months(date'1900-01-01', cast(id % 2000 as int))").alias("transaction_month"),
        F.col("id").cast("double").alias("prediction"),
    )
    forecasts = forecasts.unionByName(forecasts.limit(1).withColumn("anonymous_uu_id", F.lit(None).cast("string")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return forecasts, publish(forecasts, str(tmp_path_factory.mktemp("published")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_published_files_are_one_sorted_table(spark, many):
    forecasts, path = many
    rows = read_published(spark, path).withColumn("file", F.col("_metadata.file_name")).withColumn("row", F.monotonically_increasing_id())
    found = [(r.file, r.row, r.anonymous_uu_id or "", r.transaction_month) for r in rows.collect()]
    in_files = [(m, t) for _, _, m, t in sorted(found, key=lambda r: (r[0], r[1]))]
    assert in_files == sorted(in_files) and len(in_files) == forecasts.count()
    manifest = {r.file: r for r in read_manifest(spark, path).collect()}
    assert len(manifest) == 8
    for file, entry in manifest.items():
        names = [m for f, _, m, _ in found if f == file]
        assert (entry["first"] or min(names), entry["last"], entry["rows"]) == (min(n for n in names if n) if entry["first"] else "", max(names), len(names))
    assert sum(e["first"] <= "hot" <= e["last"] for e in manifest.values()) >= 3  # spread


@pytest.mark.parametrize("asked", [["hot"], ["m1"], ["m1", "m9999", None], ["a"], ["zzz"], [None], [], ["hot", "m5", "nobody"]])
def test_a_lookup_reads_only_its_files(spark, many, asked):
    forecasts, path = many
    requests = spark.createDataFrame([(a,) for a in asked], "anonymous_uu_id string")
    table = read_published(spark, path, requests)
    in_range = {
        r.file
        for r in read_manifest(spark, path).collect()
        if any(a is not None and r["first"] <= a <= r["last"] for a in asked)
    }
    assert {f.rsplit("/", 1)[1] for f in table.inputFiles()} == in_range or not in_range and table.count() == 0
    assert len(in_range) < 8
    assert sorted(lookup_forecasts(requests, table).collect(), key=repr) == sorted(lookup_forecasts(requests, forecasts).collect(), key=repr)


def test_files_by_blocks_of_boundaries(spark):
    """Against every file's own range, with ties over several files."""
    dice = random.Random(2)
    for n in (1, 2, 3, 7, 50):
        names = sorted(dice.choice("abcdefgh") + dice.choice("xy") for _ in range(2 * n))
        firsts, lasts = names[::2], names[1::2]
        asked = spark.createDataFrame([(x + y,) for x in "`abcdefghi" for y in "wxyz"], "anonymous_uu_id string")
        for r in asked.collect():
            one = asked.where(F.col("anonymous_uu_id") == r[0]) if n in (3, 7) else None
            if one is not None and r[0] in ("ax", "cy", "hz", "`w", "dx"):
                assert needed_files(one, firsts, lasts) == [k for k in range(n) if firsts[k] <= r[0] <= lasts[k]]
        want = [k for k in range(n) if any(firsts[k] <= r[0] <= lasts[k] for r in asked.collect())]
        assert needed_files(asked, firsts, lasts) == want
    assert needed_files(asked, [], []) == []


def test_published_nothing(spark, tmp_path, many):
    path = publish(many[0].limit(0), str(tmp_path))
    asked = spark.createDataFrame([("hot",)], "anonymous_uu_id string")
    assert read_published(spark, path, asked).count() == read_published(spark, path).count() == 0


def test_a_stream_is_answered_from_few_files_and_once(spark, tmp_path, many):
    forecasts, path = many
    inbox, outbox, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k, names in enumerate((["m6926", "nobody"], ["m6926", "hot"], ["m4838"])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"anonymous_uu_id": n}) + "\n" for n in names))

    def serve(where=state):
        answer_requests(read_requests(spark, inbox, 1), path, lookup_forecasts, outbox, where).awaitTermination()
        return sorted((r.anonymous_uu_id, r.found, r.batch) for r in spark.read.json(outbox).collect())

    got = serve()
    assert [g[:2] for g in got] == [("hot", True), ("m4838", True), ("m6926", True), ("m6926", True), ("nobody", False)]
    assert {g[2] for g in got} == {0, 1, 2}
    assert serve() == got  # nothing new
    # All batches once more, as after the loss of the stream's state: the same folder.
    assert serve(str(tmp_path / "state-2")) == got


def test_a_small_batch_reads_few_files(spark, tmp_path, many):
    _, path = many
    read = []

    def look_up(requests, table):
        read.append(table.inputFiles())
        return lookup_forecasts(requests, table)

    asked = spark.createDataFrame([("m1",)], "anonymous_uu_id string")
    for _ in range(2):
        answer_batch(asked, 7, path, look_up, str(tmp_path))
        assert [f.name for f in tmp_path.iterdir()] == ["batch=7"]
        assert spark.read.json(str(tmp_path)).count() == 1
    assert len(read[0]) <= 2


def test_only_the_merchants_asked_for_are_summed_up(spark, cleaned):
    asked = spark.createDataFrame([("merchant_A",), ("nobody",), (None,)], "anonymous_uu_id string")
    pruned = offers_from_transactions(cleaned, requests=asked, jitter=0.0)
    plain = lookup_offers(asked, offers_from_transactions(cleaned, jitter=0.0))
    assert sorted(pruned.collect(), key=repr) == sorted(plain.collect(), key=repr)
    plan = pruned._jdf.queryExecution().optimizedPlan().toString()
    semi, sums = plan.rindex("LeftSemi"), plan.index("Aggregate [anonymous_uu_id")
    assert semi > sums  # further down the tree


def test_numbers_ask_among_names(spark):
    forecasts = spark.createDataFrame([("merchant_A", month("2024-01"), 1.5)], FORECASTS)
    asked = spark.createDataFrame([(7,), (None,)], "anonymous_uu_id bigint")
    answers = lookup_forecasts(asked, forecasts)
    assert [r.found for r in answers.collect()] == [False, False]
    assert answers.schema["anonymous_uu_id"].dataType.simpleString() == "bigint"


def test_one_merchant_is_filtered_in_the_scan(spark, tmp_path, cleaned):
    """The calendar still reads all merchants, the rest only the one asked for."""
    path = str(tmp_path / "cleaned")
    cleaned.write.parquet(path)
    stored = spark.read.parquet(path)
    as_of = month_bounds(stored).select("last_month")
    everything = score_offers(continuous_series(stored), as_of=as_of, jitter=0.0)
    for offers in (everything, offers_from_transactions(stored, jitter=0.0)):
        one = offers.where("anonymous_uu_id = 'merchant_A'")
        plan = one._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "sales" in line]
        assert scans and all("EqualTo(anonymous_uu_id,merchant_A)" in scan for scan in scans)
        assert one.first().is_eligible


def test_a_narrower_calendar(spark, cleaned):
    """Sales outside it do not count, with the series or without."""
    bounds = spark.createDataFrame(
        [(month("2022-03"), month("2023-04"))], "first_month date, last_month date"
    )
    series = continuous_series(cleaned, bounds)
    dense = score_offers(series, jitter=0.0).collect()
    direct = offers_from_transactions(cleaned, bounds, jitter=0.0).collect()
    assert [tuple(r)[:5] for r in sorted(direct)] == [tuple(r)[:5] for r in sorted(dense)]
    amount = {r.anonymous_uu_id: r.advance_amount for r in direct}
    assert amount["merchant_A"] == pytest.approx(
        6 * RATE * sum(8000 + 500 * k for k in range(2, 16)) / 14
    )

    def values(forecast):
        return {(r[0], r[1]): pytest.approx(r[2]) for r in forecast.collect()}

    assert values(mean_forecast_from_transactions(cleaned, bounds, jitter=0.0)) == values(
        mean_forecast(series, jitter=0.0)
    )
    model = PipelineModel(
        stages=[
            SQLTransformer(
                statement="SELECT *, sales_lag_1 + coalesce(length(country_code), 7)"
                " AS prediction FROM __THIS__"
            )
        ]
    )
    assert values(model_forecast_from_transactions(cleaned, model, bounds)) == values(
        model_forecast(series, model)
    )
