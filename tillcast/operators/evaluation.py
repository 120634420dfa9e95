"""Hold-out split by time, and the error on it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators.features import LONGEST_AVERAGE, model_features
from tillcast.operators.training import rmse_evaluator
from tillcast.schema import MONTH, PREDICTION, SALES


def split_cutoff(series: DataFrame, test_fraction: float = 0.30) -> DataFrame:
    """One row: the first month of the test period.

    The test period is the last ``test_fraction`` of the distinct months, rounded down
    but at least one. Only the months, not the rows, come together. As a
    continuous series has the months of its calendar, ``month_calendar`` will do for it.
    """
    months = F.sort_array(F.collect_set(MONTH))
    total = F.size("months")
    test_months = F.greatest(F.floor(total * F.lit(float(test_fraction))).cast("int"), F.lit(1))
    return series.agg(months.alias("months")).select(
        F.when(total == 0, F.raise_error(F.lit("no months to split")).cast("date"))
        .otherwise(F.try_element_at("months", total - test_months + 1))
        .alias("cutoff")
    )


def temporal_split(
    series: DataFrame, test_fraction: float = 0.30, cutoff: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The months before the cutoff, and those from it on.

    Hand in ``cutoff`` (one row) if it is known; otherwise it is a subquery over ``series``.
    """
    first_test = (split_cutoff(series, test_fraction) if cutoff is None else cutoff).scalar()
    return series.where(F.col(MONTH) < first_test), series.where(F.col(MONTH) >= first_test)


def rmse(df: DataFrame, label: str = SALES, prediction: str = PREDICTION) -> DataFrame:
    """Root mean square error as a one-row DataFrame."""
    error = F.col(label) - F.col(prediction)
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def holdout_features(
    test: DataFrame, include_current: bool = True, history: DataFrame | None = None
) -> DataFrame:
    """Model features of the test rows.

    From the test rows alone, lags and averages restart and the first three months of a merchant are no
    examples. With ``history``, the training rows, its last months go before the test rows as what
    lags and averages look back on, and every observed test month has the features it would have
    in the whole series. No more than six months of a merchant are carried over.
    """
    if history is None:
        return model_features(test, include_current)
    back = LONGEST_AVERAGE - 1 if include_current else LONGEST_AVERAGE
    first_test = test.agg(F.min(MONTH).alias("first")).scalar()
    carried = history.where(F.col(MONTH) >= F.add_months(first_test, -back))
    joined = carried.withColumn("carried", F.lit(True)).unionByName(
        test.withColumn("carried", F.lit(False))
    )
    return model_features(joined, include_current).where("NOT carried").drop("carried")


def score_holdout(
    model: PipelineModel,
    test: DataFrame,
    include_current: bool = True,
    history: DataFrame | None = None,
) -> DataFrame:
    """Test rows with the model's prediction, by :func:`holdout_features`."""
    return model.transform(holdout_features(test, include_current, history))


def evaluate(
    model: PipelineModel,
    test: DataFrame,
    include_current: bool = True,
    history: DataFrame | None = None,
) -> float:
    """RMSE of the model on the test rows."""
    return rmse_evaluator().evaluate(score_holdout(model, test, include_current, history))
