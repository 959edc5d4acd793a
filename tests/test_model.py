import numpy as np
import pandas as pd
import pytest
from conftest import days, frame, result

from panelspark.operators import model as md

FEATURES = ["f", "sector_code", "g"]
SCHEMA = "ticker string, date date, f double, sector_code int, g double, target double"


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.RandomState(0)
    rows = []
    for i, d in enumerate(days(60)):
        for k in range(8):
            f, g = rng.randn(2)
            rows.append((f"T{k}", d, float(f), k % 3, float(g), float(np.sign(f) + (k % 3) * 2)))
    return frame(spark, rows, SCHEMA)


@pytest.fixture(scope="module")
def model(panel):
    return md.regressor({"max_depth": 3, "n_estimators": 4, "learning_rate": .3}, FEATURES, "target").fit(panel)


def test_importances_find_the_drivers(model):
    got = md.importances(model, FEATURES).toPandas()
    assert abs(got.importance_pct.sum() - 100) < 1e-9 and got.importance.is_monotonic_decreasing
    assert set(got.feature[:2]) == {"f", "sector_code"}


def test_incomplete_rows_keep_a_null_score(spark, panel, model):
    extra = frame(spark, [("T9", days(1)[0], None, 1, 1.0, 1.0), ("T9", days(2)[1], 1.0, -1, 1.0, None)], SCHEMA)
    scored = md.score(model, panel.unionByName(extra), FEATURES)
    got = result(scored)
    assert len(got) == 482 and scored.columns == panel.columns + ["predicted_score"]
    t9 = got[got.ticker == "T9"].sort_values("date")
    assert t9.predicted_score.isna().tolist() == [True, False]  # an unknown sector code is scored
    assert np.isnan(t9.f.iloc[0])
    assert got.predicted_score.corr(got.target) > .9


def test_save_and_load(spark, panel, model, tmp_path):
    md.save_model(model, {"max_depth": 3}, .5, FEATURES, str(tmp_path / "m"), "target")
    loaded, meta, features = md.load_model(spark, str(tmp_path / "m"))
    assert features == FEATURES and meta.best_cv_rmse == .5 and meta.n_features == 3 and meta.best_params.max_depth == "3"
    a, b = result(md.score(model, panel, FEATURES), "ticker", "date"), result(md.score(loaded, panel, features), "ticker", "date")
    assert (a.predicted_score == b.predicted_score).all()
    table = spark.read.option("header", True).csv(str(tmp_path / "m" / "importances"))
    assert table.columns == ["feature", "importance", "importance_pct"] and table.count() == 3


def test_search_and_training(panel):
    space = {"max_depth": [1, 3], "n_estimators": [2], "learning_rate": [.5]}
    renamed = panel.withColumnRenamed("target", "fwd_residual_return")
    features = ["f", "g"]
    results = md.search(renamed, features, md.sample_candidates(space, 5), n_folds=3, horizon=2)
    got = results.toPandas()
    assert len(got) == 6 and (got.rmse > 0).all()
    best = md.best_candidate(results).toPandas()
    assert best.mean_rmse.is_monotonic_increasing
    fitted, train, test, used, params, rmse = md.train_model(
        renamed, str(days(60)[39]), str(days(60)[40]), ["T0"], n_iter=1, space=space, n_folds=2)
    assert used == ["sector_code"] and rmse > 0 and params["n_estimators"] == 2
    assert train.count() == 280 and test.count() == 140


def test_sampling_is_seeded_and_distinct():
    a, b = md.sample_candidates(md.SEARCH_SPACE, 30), md.sample_candidates(md.SEARCH_SPACE, 30)
    assert a == b and len({tuple(c.items()) for c in a}) == 30
    assert pd.DataFrame(a).isin(sum(md.SEARCH_SPACE.values(), [])).all().all()


@pytest.mark.parametrize("sectors", [60, 70, 500])
def test_any_number_of_sectors_is_split_as_categories(spark, sectors):
    """Odd and even sectors differ: one split of a category is enough, one of a number is not."""
    rows = [(f"T{i}", d, 0.0, i, 0.0, float(i % 2)) for i in range(sectors) for d in days(4)]
    df = frame(spark, rows, SCHEMA)
    fitted = md.regressor({"max_depth": 1, "n_estimators": 1, "learning_rate": 1.0}, FEATURES, "target",
                          categories=md.n_categories(df)).fit(df)
    got = result(md.score(fitted, df, FEATURES))
    assert (got.predicted_score - got.target).abs().max() < 1e-9


def test_depth_without_limit_is_a_parameter():
    depth = lambda **o: md.regressor({"max_depth": -1}, ["f"], "target", **o).getStages()[-1].getMaxDepth()
    assert depth() == md.UNLIMITED_DEPTH and depth(unlimited_depth=7) == 7


def test_search_takes_any_estimator_and_folds(spark, panel):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    def estimator(params):
        return Pipeline(stages=[VectorAssembler(inputCols=["f"], outputCol="x"), LinearRegression(
            featuresCol="x", labelCol="target", predictionCol="predicted_score", regParam=params["reg"])])

    folds = spark.createDataFrame([(0, 0, 0, 20, 25), (1, 35, 40, 60, 60)], "fold int, purge_from long, lo long, hi long, embargo_to long")
    got = md.search(panel, ["f"], [{"reg": 0.0}, {"reg": 10.0}], "target", estimator=estimator, folds=folds).toPandas()
    assert sorted(zip(got.fold, got.n_train, got.n_test)) == [(0, 280, 160)] * 2 + [(1, 280, 160)] * 2
    best = md.best_candidate(spark.createDataFrame(got)).first()
    assert best.candidate == 0


def test_scores_and_training_rows_need_complete_rows_only(spark, panel, model):
    from panelspark.operators import folds as cv

    odd = frame(spark, [("T9", days(1)[0], None, 1, 1.0, 1.0), ("T9", days(2)[1], 1.0, None, 2.0, 3.0), ("T9", days(3)[2], 1.0, 1, 1.0, None)], SCHEMA)
    rows = panel.unionByName(odd)
    kept = md.model_columns(rows, ["ticker", "date"], FEATURES, "target")
    assert kept.columns == ["ticker", "date", "target", *FEATURES]
    t9 = result(kept.where("ticker = 'T9'"), "date")
    assert t9[["target", *FEATURES]].isna().sum(axis=1).tolist() == [4, 4, 1]
    train, same = (cv.training_rows(x, FEATURES, "target")[0].select(*kept.columns) for x in (rows, kept))
    assert sorted(train.collect()) == sorted(same.collect()) and train.count() == panel.count()
    one, other = (result(md.score(model, x, FEATURES), "ticker", "date").predicted_score for x in (rows, kept))
    pd.testing.assert_series_equal(one, other)
