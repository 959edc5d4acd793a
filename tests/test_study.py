import numpy as np
import pandas as pd
from conftest import BAR_DDL, bars_pdf, days, frame

from panelspark.plans.study import StudyConfig, run_study
from panelspark.sources import universe as un


def test_whole_study(spark, tmp_path):
    names = [f"T{i:02d}" for i in range(10)]
    pdf = bars_pdf(names + ["SPY", "QQQ"], 140, seed=5)
    pdf = pd.concat([pdf, bars_pdf(["NEW"], 20)])
    universe = un.from_sector_lists(spark, {"X": names[:5], "Y": names[5:]})
    config = StudyConfig(train_end=str(days(140)[99]), test_start=str(days(140)[100]), beta_window=20, min_history=100,
                         n_quantiles=2, ffd_thresh=1e-2, n_iter=1, n_folds=2, min_stocks=5,
                         search_space={"max_depth": [2], "n_estimators": [2], "learning_rate": [.1]})
    # the long regime of 200 rows never fills here, so the study runs without that feature
    from panelspark.operators import features
    wide = features.engineer_features
    features.engineer_features = lambda df, u: wide(df, u, 5, 20)
    try:
        out = run_study(frame(spark, pdf, BAR_DDL), universe, str(tmp_path), config)
    finally:
        features.engineer_features = wide
    assert out["panel"].filter("ticker = 'NEW'").count() == 0
    daily = out["daily_returns"].toPandas()
    assert len(daily) == 35 and np.isfinite(daily.net_return).all()  # the last five days have no label
    assert (daily.net_return <= daily.gross_return).all()
    assert out["ic"].count() == 35 and out["exposure"].first().mean_abs_net < 1e-9
    assert {r.series for r in out["metrics"].collect()} == {"gross", "net"} and out["benchmark_metrics"].count() == 2
    summary = spark.read.json(str(tmp_path / "results_summary")).first()
    assert summary.optimal_fracdiff_d.SPY == 0.0 and summary.config.cost_bps == 8.0
    assert summary.performance_metrics.n_trading_days == 35
    assert spark.read.option("header", True).csv(str(tmp_path / "daily_returns")).count() == 35
