"""The whole study as one dataflow: bars in, report tables and a model out."""

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import schema
from panelspark.operators import backtest, features, folds, fracdiff, labels, model, portfolio, quality, ranking
from panelspark.sources import sinks
from panelspark.storage import materialize


@dataclass
class StudyConfig:
    market: str = "SPY"
    benchmarks: tuple = tuple(schema.BENCHMARKS)
    train_end: str = schema.TRAIN_END
    test_start: str = schema.TEST_START
    beta_window: int = schema.BETA_WINDOW
    label_horizon: int = schema.LABEL_HORIZON
    rebalance_freq: int = schema.REBALANCE_FREQ
    n_quantiles: int = schema.N_QUANTILES
    cost_bps: float = schema.COST_BPS
    min_history: int = schema.MIN_HISTORY
    min_stocks: int = schema.MIN_STOCKS
    ffd_thresh: float = schema.FFD_THRESH
    n_iter: int = 30
    n_folds: int = 5
    fold_unit: str = "date"
    purge_boundary: int = 0
    return_lag: int = 0
    search_space: dict = None
    seed: int = 42


def raw_panel(bars: DataFrame, config: StudyConfig) -> DataFrame:
    """Filled bars of the tickers with enough history."""
    return quality.min_history(quality.clean(bars), config.min_history)


def feature_panel(bars: DataFrame, universe: DataFrame, config: StudyConfig) -> DataFrame:
    """Labels, differenced price and features of clean bars, before it is stored."""
    labelled = labels.label_panel(bars, config.market, config.beta_window, config.label_horizon)
    differenced = fracdiff.fracdiff_panel(labelled, config.benchmarks, thresh=config.ffd_thresh)
    return features.engineer_features(differenced, universe)


def run_study(bars: DataFrame, universe: DataFrame, out: str, config: StudyConfig = None) -> dict:
    """Run all steps and write their tables below ``out``; returns them as DataFrames, and the model.

    The bars, the feature panel, the scores and the positions are each stored once, because several later
    steps read them; everything between two stores is one lazy plan.
    """
    config = config or StudyConfig()
    spark = bars.sparkSession
    sinks.write_bars(raw_panel(bars, config), f"{out}/raw_panel")
    clean = spark.read.parquet(f"{out}/raw_panel").select(*bars.columns)
    sinks.write_panel(feature_panel(clean, universe, config), f"{out}/panel")
    panel = spark.read.parquet(f"{out}/panel")

    fitted, train, test, used, params, rmse = model.train_model(
        panel, config.train_end, config.test_start, config.benchmarks, config.purge_boundary, n_iter=config.n_iter,
        n_folds=config.n_folds, horizon=config.label_horizon, unit=config.fold_unit, space=config.search_space,
        seed=config.seed)
    model.save_model(fitted, params, rmse, used, f"{out}/model")

    scored = materialize(model.score(fitted, test, used).select(
        "date", "ticker", "predicted_score", "realized_vol_20", "daily_return", "fwd_raw_return"))
    ic = materialize(ranking.rank_ic(scored, min_stocks=config.min_stocks, p_values=True))
    positions = materialize(portfolio.construct_portfolio(
        scored, freqs=(config.rebalance_freq,), n_quantiles=config.n_quantiles, return_lag=config.return_lag))
    daily = materialize(backtest.portfolio_returns(positions, config.cost_bps))
    sinks.write_csv(daily.orderBy("date"), f"{out}/daily_returns")

    ic_summary = ranking.ic_summary(ic)
    metrics = backtest.gross_and_net_metrics(daily)
    net = metrics.filter(F.col("series") == "net").drop("series")
    d_table = fracdiff.d_per_ticker(panel)
    benchmarks = backtest.benchmark_returns(backtest.within_portfolio_dates(panel, daily), config.benchmarks)
    settings = {k: v for k, v in asdict(config).items()
                if k in ("train_end", "test_start", "label_horizon", "rebalance_freq", "cost_bps")}
    sinks.write_json(sinks.results_summary(ic_summary, net, d_table, settings), f"{out}/results_summary")
    return {
        "panel": panel, "model": fitted, "split": folds.split_summary(train, test, len(used)), "scores": scored,
        "ic": ic, "ic_summary": ic_summary, "positions": positions,
        "exposure": portfolio.exposure_summary(portfolio.weight_check(positions)), "daily_returns": daily,
        "metrics": metrics, "benchmark_metrics": backtest.benchmark_metrics(benchmarks),
        "equity": backtest.tearsheet_equity(daily, benchmarks),
    }
