from __future__ import annotations

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

import __spark_entry__ as driver
from conftest import TRANSACTIONS, month, months
from tillcast.functions.lineage import cut_lineage, scratch
from tillcast.operators.encoding import encode_categories, fit_encoder
from tillcast.operators.evaluation import (
    evaluate,
    holdout_features,
    rmse,
    score_holdout,
    split_cutoff,
    temporal_split,
)
from tillcast.operators.features import FEATURES, model_features
from tillcast.operators.forecasting import model_forecast
from tillcast.operators.series import continuous_series
from tillcast.operators.training import (
    assembled_examples,
    load_model,
    model_inputs,
    random_folds,
    regressor,
    rmse_evaluator,
    save_model,
    search_settings,
    train_forecaster,
)
from tillcast.plans.training import train_and_evaluate


def wave(k, t):
    return 1000.0 * (k + 1) + 100.0 * math.sin(t * math.pi / 6) + 10.0 * t


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        (f"m{k}", ("USD", "EUR")[k % 2], ("US", "FR", "DE")[k % 3], m, wave(k, t), 1)
        for k in range(6)
        for t, m in enumerate(months("2021-01", 30))
    ]
    return continuous_series(spark.createDataFrame(rows, TRANSACTIONS)).cache()


@pytest.fixture(scope="module")
def model(series):
    return train_forecaster(series, depths=(3,), trees=(8,))


def test_encoding_width_and_unknowns(spark):
    codes = "currency_code string, country_code string"
    df = spark.createDataFrame([("USD", "US"), ("USD", "FR"), ("EUR", None)], codes)
    encoded, encoder = encode_categories(df)
    rows = encoded.collect()
    assert [r.currency_code_indexed for r in rows] == [0.0, 0.0, 1.0]
    assert [r.country_code_indexed for r in rows] == [1.0, 0.0, 2.0]  # ties by name, null last
    assert rows[0].country_code_encoded.toArray().tolist() == [0.0, 1.0]
    assert rows[2].country_code_encoded.toArray().tolist() == [0.0, 0.0]
    later = spark.createDataFrame([("GBP", "FR")], codes)
    again, same = encode_categories(later, encoder=encoder)
    assert same is encoder
    assert again.first().currency_code_encoded.toArray().tolist() == [0.0, 0.0]


def test_trained_model(model):
    assert isinstance(model, PipelineModel)
    assert isinstance(model.stages[-1], GBTRegressionModel)
    assert model_inputs(model) == list(FEATURES)


def test_model_learns(series, model):
    assert evaluate(model, series) < 400.0  # merchants differ by 1000 and more


def test_forecasts_of_the_model(series, model):
    rows = model_forecast(series, model).collect()
    assert len(rows) == 36
    assert all(isinstance(r.prediction, float) and r.prediction >= 0 for r in rows)
    assert {r.transaction_month for r in rows} == set(months("2023-07", 6))
    mean = {
        k: sum(r.prediction for r in rows if r.anonymous_uu_id == f"m{k}") / 6 for k in range(6)
    }
    assert mean[0] < mean[2] < mean[5]


def test_saved_model_is_the_same(spark, tmp_path, series, model):
    path = str(tmp_path / "model")
    save_model(model, path)
    save_model(model, path)  # replaces it
    loaded = load_model(spark, path)
    assert model_inputs(loaded) == list(FEATURES)
    assert sorted(model_forecast(series, loaded).collect()) == sorted(
        model_forecast(series, model).collect()
    )


def test_missing_and_untrained_models(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "nothing"))
    with pytest.raises(RuntimeError):
        save_model(None, str(tmp_path / "nothing"))


def test_search_is_the_plain_search(spark, series, tmp_path):
    """Every setting fitted in every fold, by Spark's own search over the same folds."""
    depths, trees = (1, 3), (2, 6, 4)
    examples, stages = assembled_examples(series, None, True, random_folds(3), str(tmp_path))
    found = search_settings(examples, depths, trees, parallelism=3)
    plain = regressor(1, 1)
    grid = ParamGridBuilder().addGrid(plain.maxDepth, depths).addGrid(plain.maxIter, trees).build()
    searched = CrossValidator(
        estimator=plain, estimatorParamMaps=grid, evaluator=rmse_evaluator(), numFolds=3, foldCol="fold", parallelism=3
    ).fit(examples)
    assert [s.rmse for s in found] == pytest.approx(searched.avgMetrics)
    assert [(s.depth, s.trees) for s in found] == [(d, t) for d in depths for t in trees]
    assert [s.fitted for s in found] == [2, 6, 4] * 2
    best = next(s for s in found if s.chosen)
    assert (best.depth, best.trees) == (searched.bestModel.getMaxDepth(), searched.bestModel.getNumTrees)
    own = train_forecaster(series, depths, trees, parallelism=3)
    assert own.stages[-1].toDebugString.split("\n")[1:] == searched.bestModel.toDebugString.split("\n")[1:]


def test_a_flat_fit_ends_early(series, tmp_path):
    """Sales by the month of the year alone: the first trees know all."""
    flat = series.withColumn("sales_amount_actual", F.month("transaction_month") * 100.0)
    examples, _ = assembled_examples(flat, None, True, random_folds(2), str(tmp_path))
    found = search_settings(examples, (1, 5), (30, 60), folds=2, parallelism=2, tolerance=1e-9)
    by_depth = {s.depth: s for s in found if s.trees == 60}
    assert by_depth[5].fitted < 30 and by_depth[5].rmse < 1
    assert [(s.depth, s.trees) for s in found if s.chosen] == [(5, 30)]
    model = train_forecaster(flat, (1, 5), (30, 60), folds=2, parallelism=2, tolerance=1e-9)
    assert model.stages[-1].getNumTrees == by_depth[5].fitted


def test_model_search_fits_all_trees(spark, tmp_path, monkeypatch):
    """The query's sales are known after one tree; still every fit has all of them."""
    tables = {
        "region": "SELECT * FROM VALUES (0, 'ASIA'), (1, 'EUROPE') t(r_regionkey, r_name)",
        "nation": "SELECT * FROM VALUES (0, 'CHINA', 0), (1, 'FRANCE', 1) t(n_nationkey, n_name, n_regionkey)",
        "supplier": "SELECT id AS s_suppkey, int(id % 2) AS s_nationkey FROM range(1, 5)",
        "lineitem": "SELECT id AS l_suppkey, 100D AS l_extendedprice, 0D AS l_discount,"
        " CAST(make_date(1990 + int(id), 6, 15) AS TIMESTAMP_NTZ) AS l_shipdate FROM range(1, 5)",
    }
    for name, query in tables.items():
        spark.sql(query).write.parquet(f"{tmp_path}/{name}.parquet")
    found = []

    def kept(*args, **kwargs):
        found.extend(search_settings(*args, **kwargs))
        return found

    monkeypatch.setattr(driver, "search_settings", kept)
    monkeypatch.setattr(driver, "FULL_TREES", (2, 4))
    rows = driver.model_search(spark, str(tmp_path)).collect()
    assert [(s.depth, s.trees, s.fitted) for s in found] == [(d, n, n) for d in (5, 10) for n in (2, 4)]
    assert [(r.max_depth, r.trees) for r in rows if r.chosen] == [(5, 2)]


def test_folds_do_not_depend_on_partitions(series):
    def folds(df):
        return sorted(df.select("anonymous_uu_id", "transaction_month", random_folds(3).alias("f")).collect())

    found = folds(series)
    assert found == folds(series.repartition(5, "sales_amount_actual"))
    assert {r.f for r in found} == {0, 1, 2}


def test_grid_search_picks_the_better_depth(series):
    best = train_forecaster(series, depths=(1, 4), trees=(5,), folds=2, parallelism=2)
    assert best.stages[-1].getMaxDepth() == 4


def test_given_encoder_is_used(series):
    encoder = fit_encoder(series.where("currency_code is not null"))
    small = train_forecaster(series, depths=(1,), trees=(1,), encoder=encoder)
    assert small.stages[0].stages[0].uid == encoder.stages[0].uid


def test_any_number_of_labels_in_one_scan(spark):
    df = spark.range(12_000).selectExpr("string(id) AS currency_code", "'US' AS country_code")
    indexers = fit_encoder(df).stages[:2]
    assert [len(indexer.labels) for indexer in indexers] == [12_000, 1]


@pytest.mark.parametrize(
    "total, fraction, cutoff",
    [(10, 0.30, "2021-08"), (3, 0.30, "2021-03"), (1, 0.30, "2021-01"), (30, 0.30, "2022-10")],
)
def test_split(transactions, total, fraction, cutoff):
    df = continuous_series(transactions(("m", months("2021-01", total), range(1, total + 1))))
    train, test = temporal_split(df, fraction)
    assert split_cutoff(df, fraction).first().cutoff == month(cutoff)
    assert [r.transaction_month for r in test.orderBy("transaction_month").collect()][0] == month(
        cutoff
    )
    assert train.count() + test.count() == total


def test_split_of_nothing_is_an_error(spark):
    empty = continuous_series(spark.createDataFrame([], TRANSACTIONS))
    with pytest.raises(Exception, match="no months to split"):
        split_cutoff(empty).collect()


def test_rmse(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (3.0, 1.0)], "sales_amount_actual double, prediction double"
    )
    assert rmse(df).first().rmse == pytest.approx(math.sqrt(2.5))


def test_evaluate_is_the_rmse_of_the_scored_rows(series, model):
    _, test = temporal_split(series)
    scored = score_holdout(model, test)
    assert scored.count() == 6 * (9 - 3)  # lags restart in the test rows
    assert evaluate(model, test) == pytest.approx(rmse(scored).first().rmse)


@pytest.mark.parametrize("include_current", [True, False])
def test_features_across_the_cutoff_are_those_of_the_whole_series(series, include_current):
    train, test = temporal_split(series)
    first = split_cutoff(series).first().cutoff
    found = holdout_features(test, include_current, history=train)
    whole = model_features(series, include_current).where(F.col("transaction_month") >= first)
    assert found.columns == whole.columns
    assert sorted(found.collect()) == sorted(whole.collect())
    assert found.count() == 6 * 9


def test_features_across_the_cutoff_of_short_histories(spark, transactions):
    df = continuous_series(transactions(("m", months("2021-01", 4), [1, 2, 3, 4])))
    train, test = temporal_split(df)
    assert [r.sales_lag_3 for r in holdout_features(test, True, train).collect()] == [1.0]
    assert holdout_features(test, True, train.limit(0)).count() == 0
    assert holdout_features(test.limit(0), True, train).count() == 0


def test_evaluate_across_the_cutoff(series, model):
    train, test = temporal_split(series)
    scored = score_holdout(model, test, history=train)
    assert scored.count() == 6 * 9
    assert evaluate(model, test, history=train) == pytest.approx(rmse(scored).first().rmse)


def test_training_job(spark, tmp_path):
    path = tmp_path / "transactions.csv"
    lines = [
        "anonymous_uu_id,currency_code,country_code,transaction_month,sales_amount,"
        "transaction_count"
    ]
    lines += [
        f"m{k},USD,US,{m:%Y%m},{wave(k, t):.2f},1"
        for k in range(3)
        for t, m in enumerate(months("2021-01", 24))
    ]
    path.write_text("\n".join(lines) + "\n")
    model_path = str(tmp_path / "model")
    place = tmp_path / "intermediate"
    error = train_and_evaluate(spark, str(path), model_path, depths=(2,), trees=(3,), folder=str(place))
    assert 0 < error < 3000
    across = train_and_evaluate(
        spark, str(path), model_path, depths=(2,), trees=(3,), folder=str(place), across_cutoff=True
    )
    assert 0 < across < 3000 and across != error
    assert list(place.glob("scratch-*")) == []
    assert isinstance(load_model(spark, model_path), PipelineModel)


def test_lineage_is_cut_at_the_given_folder(spark, tmp_path):
    kept = cut_lineage(spark.range(10).distinct(), str(tmp_path))
    assert str(tmp_path) in kept.inputFiles()[0]
    assert "Exchange" not in kept._jdf.queryExecution().toString()
    assert kept.count() == 10


def test_scratch_leaves_nothing(spark, tmp_path):
    with scratch(spark, str(tmp_path)) as place:
        assert cut_lineage(spark.range(10), place).count() == 10
        assert len(list(tmp_path.glob("scratch-*/cut-*"))) == 1
    assert list(tmp_path.glob("*")) == []
    with pytest.raises(ZeroDivisionError):
        with scratch(spark, str(tmp_path)) as place:
            cut_lineage(spark.range(10), place)
            1 / 0
    assert list(tmp_path.glob("*")) == []
    with scratch(spark, str(tmp_path)):
        pass  # nothing was written


def test_training_leaves_no_intermediate_table(series, tmp_path):
    train_forecaster(series, depths=(1,), trees=(1, 2), folds=2, folder=str(tmp_path))
    with pytest.raises(Exception):
        train_forecaster(series, depths=(99,), trees=(1,), folder=str(tmp_path))
    assert list(tmp_path.glob("*")) == []
