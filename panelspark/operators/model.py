"""Gradient-boosted regression on a feature panel: search under purged folds, scoring, persistence."""

import itertools
import pickle
import random
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.crossrank import all_present
from panelspark.operators import folds as cv
from panelspark.schema import LABEL_HORIZON, TARGET, TEST_START, TRAIN_END, available_features
from panelspark.storage import materialize

# The search space. num_leaves has no counterpart in level-wise trees and is left out.
SEARCH_SPACE = {
    "max_depth": [4, 6, 8, -1],
    "learning_rate": [0.01, 0.05, 0.1],
    "n_estimators": [200, 500, 1000],
    "feature_fraction": [0.7, 0.8, 0.9],
    "bagging_fraction": [0.7, 0.8, 0.9],
    "min_child_samples": [20, 50, 100],
}
#: Depth of trees whose depth is not limited (-1): level-wise trees need a bound on the nodes of their last level.
UNLIMITED_DEPTH = 12
CATEGORY = "sector_code"


def sample_candidates(space: dict, n_iter: int, seed: int = 42) -> list:
    """``n_iter`` distinct settings drawn from the grid, all of it when it is smaller."""
    names = list(space)
    grid = [dict(zip(names, values)) for values in itertools.product(*space.values())]
    return grid if n_iter >= len(grid) else random.Random(seed).sample(grid, n_iter)


def n_categories(train: DataFrame) -> int:
    """Distinct sector codes of the training rows."""
    return train.select(CATEGORY).distinct().count() if CATEGORY in train.columns else 0


def regressor(params: dict, features, target=TARGET, seed: int = 42, categories: int = 64,
              unlimited_depth: int = UNLIMITED_DEPTH) -> Pipeline:
    """Assembler, category index and trees. The sector code is split as a category, not by order, whatever the number of
    sectors; ``categories`` is at least that number, else fitting fails. A code that is new in scoring is one more category."""
    stages = []
    numeric = [c for c in features if c != CATEGORY]
    inputs = list(numeric)
    if CATEGORY in features:
        stages += [
            StringIndexer(inputCol=CATEGORY, outputCol="__sector_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
        ]
        inputs.append("__sector_index")
    depth = params.get("max_depth", 5)
    trees = GBTRegressor(
        featuresCol="__features", labelCol=target, predictionCol="predicted_score", seed=seed,
        maxDepth=unlimited_depth if depth < 0 else depth, stepSize=params.get("learning_rate", 0.1),
        maxIter=params.get("n_estimators", 20), featureSubsetStrategy=str(params.get("feature_fraction", "all")),
        subsamplingRate=params.get("bagging_fraction", 1.0), minInstancesPerNode=params.get("min_child_samples", 1),
        maxBins=max(32, categories + 2), checkpointInterval=10)
    return Pipeline(stages=stages + [VectorAssembler(inputCols=inputs, outputCol="__features"), trees])


def model_inputs(features) -> list:
    """Feature names in the order of the model's vector."""
    return [c for c in features if c != CATEGORY] + ([CATEGORY] if CATEGORY in features else [])


def model_columns(panel: DataFrame, keep, features=None, target=TARGET) -> DataFrame:
    """The columns ``keep``, the target and the available features, to be stored for fitting and scoring. All rows stay; one that
    lacks a feature, which no model is fitted to and none scores, loses the others and the target, so that it takes next to no space."""
    used, _ = available_features(panel.columns, features)
    marked = panel.withColumn("__whole", all_present(used))
    return marked.select(*keep, *[F.when(F.col("__whole"), F.col(c)).alias(c) for c in dict.fromkeys([target, *used]) if c not in keep])


def search(train: DataFrame, features, candidates, target=TARGET, n_folds=5, horizon=LABEL_HORIZON,
           embargo_pct=0.01, unit="date", parallelism=4, seed=42, estimator=None, folds=None) -> DataFrame:
    """(candidate, fold, rmse, n_train, n_test, params): each setting fitted and scored on each fold.

    ``estimator(params)`` gives any estimator that writes ``predicted_score`` (default: ``regressor``). ``folds`` is any
    splitter's table (fold, purge_from, lo, hi, embargo_to): places [lo, hi) test, those outside [purge_from, embargo_to)
    train (default: purged folds). Rows and their places are stored once and filtered per fold by place. The fits
    are independent distributed jobs, submitted by a few threads.
    """
    placed = materialize(cv.add_position(train.select("date", "ticker", target, *features), unit))
    bounds = (folds if folds is not None else cv.fold_bounds(train, n_folds, horizon, embargo_pct, unit)).collect()
    if estimator is None:
        categories = n_categories(placed)
        estimator = lambda params: regressor(params, features, target, seed, categories)
    rmse = RegressionEvaluator(labelCol=target, predictionCol="predicted_score", metricName="rmse")

    def fit(job):
        i, params, b = job
        part = placed.filter((F.col("pos") < b.purge_from) | (F.col("pos") >= b.embargo_to))
        test = placed.filter((F.col("pos") >= b.lo) & (F.col("pos") < b.hi))
        fitted = estimator(params).fit(part)
        return i, b.fold, float(rmse.evaluate(fitted.transform(test))), part.count(), test.count(), str(sorted(params.items()))

    jobs = [(i, p, b) for i, p in enumerate(candidates) for b in bounds]
    with ThreadPool(parallelism) as pool:
        results = pool.map(fit, jobs)
    return train.sparkSession.createDataFrame(results, "candidate int, fold int, rmse double, n_train long, n_test long, params string")


def best_candidate(results: DataFrame) -> DataFrame:
    """Mean error per candidate, best first."""
    return results.groupBy("candidate", "params").agg(F.avg("rmse").alias("mean_rmse")).orderBy("mean_rmse", "candidate")


def fit_best(train: DataFrame, features, n_iter=30, target=TARGET, space=None, seed=42, **search_options):
    """Search, then refit the best setting on all training rows; returns (model, params, rmse, results)."""
    candidates = sample_candidates(space or SEARCH_SPACE, n_iter, seed)
    results = search(train, features, candidates, target, seed=seed, **search_options)
    best = best_candidate(results).first()
    params = candidates[best.candidate]
    estimator = search_options.get("estimator") or (lambda p: regressor(p, features, target, seed, n_categories(train)))
    return estimator(params).fit(train), params, best.mean_rmse, results


def train_model(panel: DataFrame, train_end=TRAIN_END, test_start=TEST_START, benchmarks=(), purge_boundary=0,
                target=TARGET, **options):
    """Split, search and refit; returns (model, train, test, features, params, rmse)."""
    rows, features, _ = cv.training_rows(panel, target=target, exclude_tickers=benchmarks)
    train, test = cv.time_split(rows, train_end, test_start, purge_boundary)
    cv.check_no_overlap(train, test)
    model, params, rmse, _ = fit_best(train, features, target=target, **options)
    return model, train, test, features, params, rmse


def score(model, panel: DataFrame, features, name="predicted_score") -> DataFrame:
    """Add the model's score; rows that lack a feature stay, with a null score."""
    complete = all_present(features)
    marked = panel.withColumn("__ok", complete)
    filled = marked.withColumns({
        f"__keep_{c}": F.col(c) for c in features
    }).withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(panel.schema[c].dataType)) for c in features})
    scored = model.transform(filled)
    value = F.when(F.col("__ok"), F.col("predicted_score"))
    return scored.select(
        *[F.col(f"__keep_{c}").alias(c) if c in features else F.col(c) for c in panel.columns], value.alias(name))


def score_object(model, panel: DataFrame, features, name="predicted_score") -> DataFrame:
    """Add the score of any fitted object whose ``predict`` takes rows of numbers and gives one number per row.

    The object is sent to each worker once, loaded once per task, and meets a batch of complete rows at a time. Rows that lack
    a feature (null or NaN) stay, with a null score, and are never shown to it.
    """
    held = panel.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fitted = pickle.loads(held.value)
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            complete = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if complete.any():
                out[complete] = fitted.predict(x[complete])
            yield pd.Series(out)

    scorer = F.pandas_udf(predicted, "double")
    return panel.withColumn(name, scorer(F.struct(*[F.col(c).cast("double").alias(c) for c in features])))


def importances(model, features) -> DataFrame:
    """(feature, importance, importance_pct), largest first; one row per feature."""
    spark = SparkSession.getActiveSession()
    values = model.stages[-1].featureImportances.toArray().tolist()
    total = sum(values) or 1.0
    rows = [(f, float(v), 100.0 * v / total) for f, v in zip(model_inputs(features), values)]
    return spark.createDataFrame(rows, "feature string, importance double, importance_pct double") \
        .orderBy(F.desc("importance"), "feature")


def save_model(model, params: dict, rmse: float, features, path: str, target=TARGET) -> None:
    """Model, metadata (JSON) and importances (CSV) below ``path``."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    meta = [("GBTRegressor", {k: str(v) for k, v in params.items()}, float(rmse), list(features), len(features), target)]
    spark.createDataFrame(meta, "model_type string, best_params map<string,string>, best_cv_rmse double, "
                                "feature_names array<string>, n_features int, target string") \
        .write.mode("overwrite").json(f"{path}/metadata")
    importances(model, features).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/importances")


def load_model(spark: SparkSession, path: str):
    """(model, metadata row, feature names)."""
    meta = spark.read.json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), meta, list(meta.feature_names)
