"""The training job: split by time, train, save, load, evaluate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tillcast.functions.lineage import cut_lineage, scratch
from tillcast.operators.evaluation import evaluate, split_cutoff, temporal_split
from tillcast.operators.training import FULL_DEPTHS, FULL_TREES, load_model, save_model, train_forecaster
from tillcast.plans.preparation import series_from_raw
from tillcast.sources.transactions import read_raw_transactions


def train_and_evaluate(
    spark: SparkSession,
    transactions_path: str,
    model_path: str,
    depths: Sequence[int] = FULL_DEPTHS,
    trees: Sequence[int] = FULL_TREES,
    test_fraction: float = 0.30,
    include_current: bool = True,
    folds: int = 3,
    parallelism: int = 1,
    seed: int = 42,
    encoder: PipelineModel | None = None,
    folder: str | None = None,
    across_cutoff: bool = False,
) -> float:
    """Train on the earlier months, save, and give the saved model's RMSE on the later.

    With ``across_cutoff`` the first test months are scored too, by features that look back into the
    training months. The series is read by several jobs, so it is written once, below ``folder``, and
    removed at the end.
    """
    with scratch(spark, folder) as place:
        series = cut_lineage(series_from_raw(read_raw_transactions(spark, transactions_path)), place)
        cutoff = cut_lineage(split_cutoff(series, test_fraction), place)
        train, test = temporal_split(series, cutoff=cutoff)
        model = train_forecaster(
            train, depths, trees, folds, parallelism, seed, include_current, encoder, place
        )
        save_model(model, model_path)
        history = train if across_cutoff else None
        return evaluate(load_model(spark, model_path), test, include_current, history)
