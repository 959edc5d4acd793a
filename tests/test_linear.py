import numpy as np
import pandas as pd
import pytest
from conftest import close_to, days, frame, result
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from panelspark.operators import linear as ln
from panelspark.operators import model as md

SCHEMA = "ticker string, date date, f double, g double, target double"
SETTINGS = [{"features": f, "reg": r} for f in (["f"], ["g"], ["f", "g"]) for r in (0.0, 0.1, 5.0)]


@pytest.fixture(scope="module")
def rows():
    """Features far from zero, so that plain sums of squares would lose digits."""
    rng = np.random.RandomState(0)
    out = []
    for d in days(60):
        for k in range(8):
            f, g, e = map(float, rng.randn(3))
            out.append((f"T{k}", d, 1e6 + f, g, f - 2 * g + e / 10))
    return out


def test_search_equals_one_fit_per_setting_and_fold(spark, rows):
    panel = frame(spark, [(t, d, f - 1e6, g, y) for t, d, f, g, y in rows], SCHEMA)
    plain = [s for s in SETTINGS if not s["reg"]]

    def estimator(p):
        return Pipeline(stages=[VectorAssembler(inputCols=p["features"], outputCol="x"), LinearRegression(
            featuresCol="x", labelCol="target", predictionCol="predicted_score", regParam=p["reg"], standardization=False, solver="normal")])

    want = result(md.search(panel, ["f", "g"], plain, "target", n_folds=3, horizon=2, estimator=estimator), "candidate", "fold")
    got = result(ln.ridge_search(panel, plain, "target", n_folds=3, horizon=2), "candidate", "fold")
    assert len(got) == 9 and got[["candidate", "fold", "n_train", "n_test", "params"]].equals(want[["candidate", "fold", "n_train", "n_test", "params"]])
    close_to(got.rmse, want.rmse, 1e-6)


def test_errors_equal_numpy(spark, rows):
    got = result(ln.ridge_search(frame(spark, rows, SCHEMA), SETTINGS, "target", n_folds=4, horizon=3, embargo_pct=0.05), "candidate", "fold")
    data = pd.DataFrame(rows, columns=["ticker", "date", "f", "g", "target"])
    pos = data.date.rank(method="dense").to_numpy() - 1
    for r in got.itertuples():
        s, lo, hi = SETTINGS[r.candidate], 15 * r.fold, 15 * (r.fold + 1)
        test, learn = (pos >= lo) & (pos < hi), (pos < lo - 3) | (pos >= hi + 3)
        x, y = data[s["features"]].to_numpy(), data.target.to_numpy()
        mx, my = x[learn].mean(0), y[learn].mean()
        z = x[learn] - mx
        b = np.linalg.solve(z.T @ z / len(z) + s["reg"] * np.eye(z.shape[1]), z.T @ (y[learn] - my) / len(z))
        assert (r.n_train, r.n_test) == (learn.sum(), test.sum())
        assert abs(r.rmse - np.sqrt(np.mean((y[test] - my - (x[test] - mx) @ b) ** 2))) < 1e-8


def test_incomplete_rows_empty_folds_and_empty_tables(spark, rows):
    more = [("T9", days(1)[0], None, 1.0, 1.0), ("T9", days(2)[1], 1.0, float("nan"), None)]
    plain, extra = frame(spark, rows, SCHEMA), frame(spark, rows + more, SCHEMA)
    assert result(ln.ridge_search(plain, SETTINGS, "target"), "candidate", "fold").equals(
        result(ln.ridge_search(extra, SETTINGS, "target"), "candidate", "fold"))
    nothing = spark.createDataFrame([(0, 0, 100, 200, 200), (1, 0, 0, 60, 60)], "fold int, purge_from long, lo long, hi long, embargo_to long")
    assert result(ln.ridge_search(plain, SETTINGS[:1], "target", folds=nothing)).rmse.isna().all()
    assert result(ln.ridge_search(plain.limit(0), SETTINGS[:1], "target")).rmse.isna().all()
    with pytest.raises(ValueError):
        ln.ridge_fit(plain.limit(0), ["f"], "target")


def test_rows_are_read_once_for_all_settings(spark, rows):
    """The sums of a task: a number per stretch and pair of columns, not per setting or row."""
    placed = frame(spark, [(i % 60, float(i), float(i * i % 7)) for i in range(1000)], "pos long, f double, target double")
    sums, shift = ln.fold_sums(placed, ["f", "target"], [10, 20, 50])
    assert sums.shape == (4, 3, 3) and sums[:, 0, 0].sum() == 1000 and sums[0, 0, 0] == 170
    close_to(sums.sum(0)[0, 1:], [0, 0], 1e-6)
    close_to(shift, [499.5, np.mean([i * i % 7 for i in range(1000)])])


def test_any_object_with_predict_scores(spark, rows):
    class Cubed:
        """Any object: no base class, and an error for missing values."""

        def predict(self, x):
            assert not np.isnan(x).any() and len(x)
            return x[:, 0] ** 3 + x[:, 1]

    more = [("T9", days(1)[0], None, 1.0, 1.0), ("T9", days(2)[1], 2.0, None, None), ("T9", days(3)[2], 2.0, 1.0, None)]
    got = md.score_object(Cubed(), frame(spark, rows[:50] + more, SCHEMA), ["f", "g"], "s")
    assert got.columns == ["ticker", "date", "f", "g", "target", "s"]
    got = result(got)
    t9 = got[got.ticker == "T9"].sort_values("date")
    assert t9.s.isna().tolist() == [True, True, False] and t9.s.iloc[2] == 9
    close_to(got[got.ticker != "T9"].s, [f ** 3 + g for _, _, f, g, _ in rows[:50]], 1e-12)


def test_fit_scores_as_numpy(spark, rows):
    fit = ln.ridge_fit(frame(spark, rows, SCHEMA), ["f", "g"], "target")
    x = np.array([[r[2], r[3]] for r in rows])
    a = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x - x.mean(0)]), np.array([r[4] for r in rows]), rcond=None)[0]
    close_to(fit.predict(x), a[0] + (x - x.mean(0)) @ a[1:], 1e-6)
