from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.ranks import with_place
from tillcast.operators.dictionary import (
    encode_with_dictionary,
    fit_dictionary,
    index_categories,
    read_dictionary,
)
from tillcast.operators.encoding import encode_categories


@pytest.fixture(scope="module")
def codes(spark):
    dice = random.Random(1)
    names = [f"c{k}" for k in range(40)] + ["é", " ", "z'"]
    rows = [
        (k, "USD" if k % 3 else dice.choice(names), dice.choice(names + [None]), "kept")
        for k in range(3000)
    ]
    return spark.createDataFrame(rows, "id int, currency_code string, country_code string, label_x string")


def test_same_as_the_fitted_encoder(codes, tmp_path):
    dictionary = fit_dictionary(codes, str(tmp_path / "labels"))
    found = encode_with_dictionary(codes, dictionary, str(tmp_path))
    want, _ = encode_categories(codes)
    assert sorted(found.columns) == sorted(want.columns)
    plain = ["id", "currency_code_indexed", "country_code_indexed", "label_x"]
    vectors = [vector_to_array(f"{c}_encoded").alias(c) for c in ("currency_code", "country_code")]
    assert sorted(found.select(*plain, *vectors).collect()) == sorted(want.select(*plain, *vectors).collect())


def test_vectors_are_sparse_and_fit_for_a_model(codes, tmp_path):
    dictionary = fit_dictionary(codes, str(tmp_path / "labels"))
    found = encode_with_dictionary(codes, dictionary, str(tmp_path))
    vector = found.where("country_code IS NOT NULL").first().country_code_encoded
    assert type(vector).__name__ == "SparseVector" and vector.numNonzeros() == 1
    model = LinearRegression(featuresCol="currency_code_encoded", labelCol="id").fit(found)
    assert model.numFeatures == dictionary.sizes["currency_code"]


def test_unknown_labels_and_other_types(spark, codes, tmp_path):
    path = str(tmp_path / "labels")
    fit_dictionary(codes, path)
    dictionary = read_dictionary(spark, path)
    later = spark.createDataFrame([("GBP", None), ("USD", "é")], "currency_code string, country_code string")
    rows = index_categories(later, dictionary).orderBy("currency_code").collect()
    assert [r.currency_code_indexed for r in rows] == [dictionary.sizes["currency_code"], 0]
    assert rows[0].country_code_indexed == dictionary.sizes["country_code"]
    numbers = spark.createDataFrame([(1,), (2,), (2,)], "n bigint")
    by_number = fit_dictionary(numbers, str(tmp_path / "n"), ["n"])
    assert sorted(index_categories(numbers, by_number).collect()) == [(1, 1.0), (2, 0.0), (2, 0.0)]


def test_an_empty_label_is_a_label(spark, tmp_path):
    df = spark.createDataFrame([("",), ("",), ("a",)], "key string")
    dictionary = fit_dictionary(df, str(tmp_path / "labels"), ["key"])
    assert sorted(r.key_indexed for r in index_categories(df, dictionary).collect()) == [0.0, 0.0, 1.0]


def test_no_labels(spark, tmp_path):
    nothing = spark.createDataFrame([], "currency_code string, country_code string")
    dictionary = fit_dictionary(nothing, str(tmp_path / "labels"))
    assert dictionary.sizes == {"currency_code": 0, "country_code": 0}
    nulls = spark.createDataFrame([(None, None)], nothing.schema)
    row = encode_with_dictionary(nulls, dictionary, str(tmp_path)).first()
    assert (row.currency_code_indexed, row.country_code_encoded.size) == (0.0, 0)


def test_a_million_labels_stay_off_the_driver(spark, tmp_path, monkeypatch):
    df = spark.range(1_000_000).selectExpr("concat('k', id) AS code_", "id").withColumnRenamed("code_", "key")
    df = df.unionByName(df.where("id % 100000 = 7"))  # ten labels that occur twice
    sent, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        sent.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    dictionary = fit_dictionary(df, str(tmp_path / "labels"), ["key"])
    encoded = encode_with_dictionary(df, dictionary, str(tmp_path))
    assert dictionary.sizes == {"key": 1_000_000} and sum(sent) <= 2
    monkeypatch.undo()
    by_name = sorted((f"k{i}" for i in range(1_000_000)), key=lambda k: (int(k[1:]) % 100000 != 7, k))
    asked = [f"k{i}" for i in (7, 900007, 0, 123456, 999999)]
    found = {r.key: r.key_encoded for r in encoded.where(F.col("key").isin(asked)).collect()}
    assert {k: (v.size, v.indices.tolist()) for k, v in found.items()} == {k: (1_000_000, [by_name.index(k)]) for k in asked}


def test_a_label_that_most_rows_have_is_split(spark, tmp_path):
    """The join of a hot label is divided over several tasks."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k) for k in small}
    rows = spark.range(200_000).selectExpr("if(id % 10 < 9, 'hot', concat('k', id)) AS key", "id")
    dictionary = fit_dictionary(rows, str(tmp_path / "labels"), ["key"])
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = index_categories(rows, dictionary)
        assert found.where("key_indexed = 0").count() == 180_000
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_places(spark, tmp_path):
    dice = random.Random(3)
    rows = [(dice.choice("aab") if k % 50 else None, dice.randrange(40), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(7)
    found = with_place(df, "g", [F.desc("x"), F.asc("id")], str(tmp_path)).where("g IS NOT NULL").collect()
    for g in "ab":
        own = sorted((-x, i) for h, x, i in rows if h == g)
        assert [(-r.x, r.id) for r in sorted((r for r in found if r.g == g), key=lambda r: r.place)] == own
        assert sorted(r.place for r in found if r.g == g) == list(range(Counter(r[0] for r in rows)[g]))
