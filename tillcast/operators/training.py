"""The gradient-boosted-tree forecaster: search, train, save, load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import isnan, sqrt
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.lineage import cut_lineage, scratch
from tillcast.operators.encoding import fit_encoder
from tillcast.operators.features import CALENDAR, FEATURES, LAGS, AVERAGES, model_features
from tillcast.schema import CODES, MERCHANT, MONTH, PREDICTION, SALES

# The full search.
FULL_DEPTHS = (5, 10)
FULL_TREES = (300, 500)

FOLD = "fold"
#: Settings whose errors differ by less than this share count as equally good.
SAME_ERROR = 1e-6


@dataclass(frozen=True)
class Setting:
    """A depth and a number of trees, with the mean RMSE over the folds.

    ``fitted`` is how many of the trees were fitted at most.
    """

    depth: int
    trees: int
    rmse: float
    fitted: int
    chosen: bool = False


def regressor(depth: int, trees: int, seed: int = 42, min_gain: float = 0.0) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol=SALES,
        predictionCol=PREDICTION,
        seed=seed,
        stepSize=0.3,
        maxDepth=depth,
        maxIter=trees,
        minInfoGain=min_gain,
    )


def random_folds(folds: int, seed: int = 42) -> Column:
    """A fold for every merchant and month, the same whatever the partitions or retries."""
    return F.pmod(F.xxhash64(F.lit(seed), MERCHANT, MONTH), F.lit(folds)).cast("int")


def assembled_examples(
    series: DataFrame,
    encoder: PipelineModel | None,
    include_current: bool,
    fold: Column,
    folder: str,
) -> tuple[DataFrame, list]:
    """Feature vector, sales and fold of every example, written below ``folder``, and the stages that made it.

    Codes are encoded and vectors assembled once, before all fits.
    """
    columns = [SALES, *LAGS, *AVERAGES, *CALENDAR, *CODES]
    rows = cut_lineage(
        model_features(series, include_current).select(*columns, fold.alias(FOLD)), folder
    )
    encoder = encoder or fit_encoder(rows)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    vectors = assembler.transform(encoder.transform(rows)).select("features", SALES, FOLD)
    return cut_lineage(vectors, folder), [encoder, assembler]


def search_settings(
    examples: DataFrame,
    depths: Sequence[int],
    trees: Sequence[int],
    folds: int = 3,
    parallelism: int = 1,
    seed: int = 42,
    min_gain: float = 0.0,
    tolerance: float | None = None,
) -> list[Setting]:
    """Cross-validate every pair of ``depths`` and ``trees``; one of the settings is ``chosen``.

    Boosting adds one tree after the other, so the model with few trees is the beginning of the one
    with many. Each depth is fitted once a fold, with the most trees, and one pass over the
    fold's held-out rows gives the error after every tree: all numbers of trees come from one fit. The
    least error is chosen, and the first of equally good settings (see ``SAME_ERROR``).
    Folds without rows do not count. ``parallelism`` fits run at the same time.

    All trees are fitted unless a ``tolerance`` is given, to save time: a fit then ends at the first tree
    that lowers the held-out squared error by less than this share of it, and more trees
    count as no better.
    """
    most = max(trees)

    def errors(task: tuple[int, int]) -> list[float]:
        depth, fold = task
        held = F.col(FOLD) == fold
        boosted = regressor(depth, most, seed, min_gain)
        if tolerance is None:
            model = boosted.fit(examples.where(~held).select("features", SALES))
        else:
            boosted.setValidationIndicatorCol("held")
            boosted.set(boosted.validationTol, tolerance)
            model = boosted.fit(examples.select("features", SALES, held.alias("held")))
        return model.evaluateEachIteration(examples.where(held).select("features", SALES), "squared")

    tasks = [(depth, fold) for depth in depths for fold in range(folds)]
    with ThreadPool(max(1, parallelism)) as pool:
        run = inheritable_thread_target(examples.sparkSession)(errors)
        found = dict(zip(tasks, pool.map(run, tasks, chunksize=1)))
    settings = []
    for depth in depths:
        by_fold = [found[depth, fold] for fold in range(folds)]
        for n in trees:
            last = [errors_[min(n, len(errors_)) - 1] for errors_ in by_fold]
            known = [sqrt(x) for x in last if not isnan(x)]
            mean = sum(known) / len(known) if known else float("inf")
            settings.append(Setting(depth, n, mean, min(n, max(map(len, by_fold)))))
    least = min(s.rmse for s in settings)
    best = next(s for s in settings if s.rmse <= least * (1 + SAME_ERROR))
    return [replace(s, chosen=s is best) for s in settings]


def train_forecaster(
    series: DataFrame,
    depths: Sequence[int] = FULL_DEPTHS,
    trees: Sequence[int] = FULL_TREES,
    folds: int = 3,
    parallelism: int = 1,
    seed: int = 42,
    include_current: bool = True,
    encoder: PipelineModel | None = None,
    folder: str | None = None,
    fold: Column | None = None,
    min_gain: float = 0.0,
    tolerance: float | None = None,
) -> PipelineModel:
    """One model for all merchants: encoder, assembler and boosted trees.

    Every pair of ``depths`` and ``trees`` is cross-validated by :func:`search_settings` and the best is
    fitted to all examples (a single pair is fitted at once). The default is the full search: seven
    fits. Examples are written below ``folder`` (see :func:`scratch`) first and removed at the end.
    ``fold`` numbers the folds from 0, by default at random by merchant and month. Splits
    that gain less than ``min_gain`` are not made. With a ``tolerance`` (see :func:`search_settings`) the last
    fit has as many trees as the longest of the folds' fits.
    """
    with scratch(series.sparkSession, folder) as place:
        fold = random_folds(folds, seed) if fold is None else fold
        examples, stages = assembled_examples(series, encoder, include_current, fold, place)
        if len(depths) == len(trees) == 1:
            depth, n = depths[0], trees[0]
        else:
            settings = search_settings(
                examples, depths, trees, folds, parallelism, seed, min_gain, tolerance
            )
            depth, n = next((s.depth, s.fitted) for s in settings if s.chosen)
        model: GBTRegressionModel = regressor(depth, n, seed, min_gain).fit(
            examples.select("features", SALES)
        )
    return PipelineModel(stages=[*stages, model])


def rmse_evaluator() -> RegressionEvaluator:
    """RMSE of ``prediction`` against the actual sales."""
    return RegressionEvaluator(labelCol=SALES, predictionCol=PREDICTION, metricName="rmse")


def save_model(model: PipelineModel | None, path: str) -> None:
    """Write the model to ``path``, in place of one that is there."""
    if model is None:
        raise RuntimeError("there is no trained model to save")
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Read a saved model; ``FileNotFoundError`` if there is none at ``path``."""
    try:
        return PipelineModel.read().session(spark).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no model at {path}") from error


def model_inputs(model: PipelineModel) -> list[str]:
    """The feature columns a loaded model was assembled from."""
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
