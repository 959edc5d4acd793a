"""The registered queries: name -> function of (session, folder of the given tables)."""

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import ewm as ew
from panelspark.operators import backtest as bt
from panelspark.operators import features as ft
from panelspark.operators import folds as cv
from panelspark.operators import fracdiff as fd
from panelspark.operators import labels as lb
from panelspark.operators import linear as ln
from panelspark.operators import model as md
from panelspark.operators import portfolio as pf
from panelspark.operators import quality as ql
from panelspark.operators import ranking as rk
from panelspark.operators import scenarios as sc
from panelspark.plans import inputs as src
from panelspark.sources import bars as sb
from panelspark.sources import sinks as sk
from panelspark.sources import universe as un
from panelspark.schema import TARGET
from panelspark.storage import materialize, stored, work_dir

DIGITS = 6
START, END = "1996-01-01", "1999-12-31"
TRAIN_END, TEST_START = "1999-12-31", "2000-01-01"
BENCHMARKS = [src.MARKET, "S1"]
FREQS = (5, 10, 21)

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, integers to 64 bits: the form in which results are compared."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c, DIGITS) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def columns(df: DataFrame, *names) -> DataFrame:
    return rounded(df.select("ticker", "date", *names))


# bars, quality, universe

@query
def bars_daily(spark, d):
    return rounded(src.daily_bars(spark, d))


@query
def bars_weekly(spark, d):
    return rounded(src.weekly_bars(spark, d))


@query
def bars_users(spark, d):
    return rounded(src.user_bars(spark, d))


@query
def date_range_scan(spark, d):
    return rounded(src.daily_bars(spark, d, START, END))


@query
def dedupe_first(spark, d):
    rows = src.table(spark, d, "lineitem").select(
        src.supplier_ticker().alias("ticker"), F.to_date("l_shipdate").alias("date"),
        src.price().alias("price"), "l_quantity", *src.ORDER)
    return rounded(sb.dedupe_first(rows, src.DAY_ORDER, digits=src.DAY_DIGITS).select("ticker", "date", "price", "l_quantity"))


@query
def gap_report(spark, d):
    return rounded(ql.gap_report(src.daily_bars(spark, d)))


@query
def forward_fill(spark, d):
    return rounded(ql.clean(src.holey_bars(spark, d)))


@query
def history_report(spark, d):
    return rounded(ql.history_report(src.daily_bars(spark, d)))


@query
def min_history(spark, d):
    return columns(ql.min_history(src.daily_bars(spark, d)), "close")


@query
def universe_dim(spark, d):
    return rounded(src.supplier_universe(spark, d))


@query
def sector_counts(spark, d):
    return rounded(un.sector_counts(src.supplier_universe(spark, d)))


# labels

@query
def daily_return(spark, d):
    return columns(lb.daily_return(src.daily_bars(spark, d)), "daily_return")


@query
def rolling_beta(spark, d):
    return columns(lb.residual_returns(src.stored_bars(spark, d), src.MARKET), "rolling_beta", "rolling_alpha")


@query
def residual_return(spark, d):
    return columns(lb.residual_returns(src.stored_bars(spark, d), src.MARKET), "market_return", "residual_return")


@query
def forward_targets(spark, d):
    return columns(lb.label_panel(src.stored_bars(spark, d), src.MARKET), "fwd_residual_return", "fwd_raw_return")


@query
def label_coverage(spark, d):
    return rounded(lb.label_coverage(lb.label_panel(src.stored_bars(spark, d), src.MARKET)))


@query
def triple_barrier(spark, d):
    bars = lb.daily_return(src.daily_bars(spark, d)).withColumn("vol", F.round(ft.realized_vol(20), 9))
    return columns(lb.triple_barrier(bars, pt_mult=1.0, sl_mult=1.0), "barrier_label", "barrier_date")


# features on weekly bars

def weekly_returns(spark, d):
    return lb.daily_return(src.weekly_bars(spark, d))


@query
def parkinson(spark, d):
    return columns(src.weekly_bars(spark, d).withColumns({
        "parkinson_vol_10": ft.parkinson(10), "parkinson_vol_20": ft.parkinson(20)}),
        "parkinson_vol_10", "parkinson_vol_20")


@query
def garman_klass(spark, d):
    return columns(src.weekly_bars(spark, d).withColumns({
        "garman_klass_vol_10": ft.garman_klass(10), "garman_klass_vol_20": ft.garman_klass(20)}),
        "garman_klass_vol_10", "garman_klass_vol_20")


@query
def amihud(spark, d):
    df = weekly_returns(spark, d).withColumn("dollar_volume", F.col("close") * F.col("volume"))
    return columns(df.withColumn("amihud_illiq_20", ft.amihud(20)), "dollar_volume", "amihud_illiq_20")


@query
def atr_and_regime(spark, d):
    df = src.weekly_bars(spark, d).withColumn("true_range", ft.true_range())
    return columns(ft.vol_regime(df).withColumn("atr_20", ft.atr(20)), "true_range", "atr_20", "vol_regime")


@query
def volume_features(spark, d):
    df = src.weekly_bars(spark, d).withColumns({
        "volume_zscore": ft.volume_zscore(20), "volume_sma_10": ft.mean("volume", 10),
        "volume_change": ft.change("volume")})
    return columns(df, "volume_zscore", "volume_sma_10", "volume_change")


@query
def moving_averages(spark, d):
    df = src.weekly_bars(spark, d).withColumns(ft.moving_averages())
    return columns(df.withColumn("close_to_sma20", ft.div("close", "sma_20")),
                   "sma_10", "sma_20", "sma_50", "close_to_sma20")


@query
def bollinger(spark, d):
    return columns(ft.bollinger(src.weekly_bars(spark, d)), "bb_upper", "bb_lower", "bb_width")


@query
def realized_vol(spark, d):
    return columns(weekly_returns(spark, d).withColumns({
        "realized_vol_10": ft.realized_vol(10), "realized_vol_20": ft.realized_vol(20)}),
        "realized_vol_10", "realized_vol_20")


@query
def lags_and_momentum(spark, d):
    df = weekly_returns(spark, d).withColumns({
        **ft.return_lags(), **ft.momentum(), "hl_spread_pct": ft.hl_spread() * 100})
    return columns(df, "return_lag_1", "return_lag_2", "return_lag_3", "return_lag_5",
                   "momentum_5", "momentum_10", "momentum_20", "hl_spread_pct")


@query
def rsi(spark, d):
    return columns(ft.rsi(src.weekly_bars(spark, d)), "rsi_14")


@query
def macd(spark, d):
    return columns(ft.macd(src.weekly_bars(spark, d)), "macd", "macd_signal", "macd_hist")


PANEL_COLUMNS = [
    "parkinson_vol_10", "parkinson_vol_20", "garman_klass_vol_10", "garman_klass_vol_20", "dollar_volume",
    "amihud_illiq_20", "atr_20", "vol_regime", "volume_zscore", "sma_10", "sma_20", "sma_50", "close_to_sma20",
    "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width", "realized_vol_10",
    "realized_vol_20", "hl_spread", "volume_sma_10", "volume_change", "return_lag_1", "return_lag_2",
    "return_lag_3", "return_lag_5", "momentum_5", "momentum_10", "momentum_20", "sector", "sector_code",
]


@query
def feature_panel(spark, d):
    return columns(src.feature_panel(spark, d), *PANEL_COLUMNS)


# fractional differencing

@query
def ffd_apply(spark, d):
    logs = fd.log_price(src.daily_bars(spark, d))
    grid = [0.2, 0.4, 0.6, 0.8, 1.0]
    return columns(fd.ffd(logs, grid), "log_close", *[fd.column_name(x) for x in grid])


@query
def unit_root_tests(spark, d):
    return rounded(fd.unit_root_table(fd.log_price(src.daily_bars(spark, d))))


@query
def unit_root_of_columns(spark, d):
    """The test on stored columns: log price, daily return and volume."""
    logs = fd.log_price(lb.daily_return(src.daily_bars(spark, d)))
    return rounded(fd.unit_root(logs, ["log_close", "daily_return", "volume"]))


@query
def unit_root_p_values(spark, d):
    return rounded(fd.unit_root_table(fd.log_price(src.daily_bars(spark, d)), p_values=True))


@query
def optimal_d(spark, d):
    return rounded(fd.optimal_d(fd.unit_root_table(fd.log_price(src.daily_bars(spark, d)))))


@query
def fracdiff_panel(spark, d):
    bars = src.daily_bars(spark, d).select("ticker", "date", "close")
    return columns(fd.fracdiff_panel(bars, [src.MARKET]), "log_close", "fracdiff_d", "fracdiff_close")


@query
def fracdiff_long_memory(spark, d):
    """Full-length filters (up to 1,000 rows)."""
    bars = src.daily_bars(spark, d).select("ticker", "date", "close")
    return columns(fd.fracdiff_panel(bars, [src.MARKET]), "log_close", "fracdiff_d", "fracdiff_close")


@query
def d_summary(spark, d):
    tests = fd.unit_root_table(fd.log_price(src.daily_bars(spark, d)))
    return rounded(fd.d_summary(fd.optimal_d(tests), [src.MARKET]))


# ranking

@query
def rank_ic(spark, d):
    return rounded(rk.rank_ic(src.score_panel(spark, d)))


@query
def rank_ic_p_values(spark, d):
    return rounded(rk.rank_ic(src.score_panel(spark, d), p_values=True))


@query
def ic_summary(spark, d):
    # a correlation that is zero but for rounding must not count as positive
    ic = rk.rank_ic(src.score_panel(spark, d)).withColumn("ic", F.round("ic", 12))
    return rounded(rk.ic_summary(ic))


@query
def cumulative_ic(spark, d):
    return rounded(rk.cumulative_ic(materialize(rk.rank_ic(src.score_panel(spark, d)))))


# portfolio

def scored(spark, d):
    """Score rows under the names that the leg and weight functions use."""
    panel = src.score_panel(spark, d)
    return panel.filter(F.col("predicted_score").isNotNull() & F.col("realized_vol_20").isNotNull()) \
        .select("date", "ticker", F.col("predicted_score").alias("score"), F.col("realized_vol_20").alias("vol"))


@query
def quantile_legs(spark, d):
    return rounded(pf.quantile_legs(scored(spark, d)).select("date", "ticker", "leg"))


@query
def inverse_vol_weights(spark, d):
    legs = materialize(pf.quantile_legs(scored(spark, d)))
    return rounded(pf.inverse_vol_weights(legs).select("date", "ticker", "leg", "weight"))


@query
def rebalance_schedule(spark, d):
    return rounded(pf.rebalance_schedule(src.score_panel(spark, d)))


def positions(spark, d, freqs=(5,), bars=None):
    return materialize(pf.construct_portfolio(src.score_panel(spark, d, bars), freqs=freqs))


def daily_table(spark, d):
    return bt.portfolio_returns(positions(spark, d))


@query
def portfolio_positions(spark, d):
    return rounded(positions(spark, d))


@query
def next_day_positions(spark, d):
    panel = src.score_panel(spark, d)
    return rounded(pf.construct_portfolio(panel, return_lag=1).select("date", "ticker", "weight", "daily_return"))


@query
def portfolio_summary(spark, d):
    panel = src.score_panel(spark, d)
    return rounded(pf.portfolio_summary(pf.construct_portfolio(panel), pf.rebalance_schedule(panel)))


@query
def weight_check(spark, d):
    return rounded(pf.weight_check(positions(spark, d)))


@query
def exposure_summary(spark, d):
    return rounded(pf.exposure_summary(pf.weight_check(positions(spark, d))))


# backtest

@query
def portfolio_returns(spark, d):
    return rounded(daily_table(spark, d))


@query
def performance_metrics(spark, d):
    return rounded(bt.gross_and_net_metrics(materialize(daily_table(spark, d))))


@query
def drawdown(spark, d):
    return rounded(bt.tearsheet_drawdown(daily_table(spark, d)))


@query
def rolling_sharpe(spark, d):
    return rounded(bt.rolling_sharpe(daily_table(spark, d)))


def benchmark_curves(spark, d, start=None, end=None):
    return bt.benchmark_returns(lb.daily_return(src.bars_of(spark, d, BENCHMARKS)), BENCHMARKS, start, end)


@query
def benchmark_curve(spark, d):
    return rounded(benchmark_curves(spark, d, START, END))


@query
def benchmark_metrics(spark, d):
    return rounded(bt.benchmark_metrics(benchmark_curves(spark, d, START, END)))


@query
def tearsheet_equity(spark, d):
    daily = materialize(daily_table(spark, d))
    panel = bt.within_portfolio_dates(lb.daily_return(src.bars_of(spark, d, BENCHMARKS)), daily)
    return rounded(bt.tearsheet_equity(daily, bt.benchmark_returns(panel, BENCHMARKS)))


@query
def tearsheet_ic(spark, d):
    return rounded(bt.tearsheet_ic(materialize(rk.rank_ic(src.score_panel(spark, d)))))


# scenarios

@query
def cost_sweep(spark, d):
    return rounded(sc.cost_sweep(materialize(daily_table(spark, d))))


@query
def rebalance_sweep(spark, d):
    return rounded(sc.rebalance_sweep(positions(spark, d, FREQS)))


@query
def breakeven_cost(spark, d):
    daily = bt.portfolio_returns(positions(spark, d, FREQS), keys=["rebalance_freq"])
    return rounded(sc.breakeven_cost(daily, ["rebalance_freq"]))


@query
def screener(spark, d):
    daily = src.stored_bars(spark, d)
    bars = lb.residual_returns(daily, src.MARKET)
    panel = fd.fracdiff_panel(bars.withColumn("parkinson_vol_20", ft.parkinson(20)), [src.MARKET])
    panel = ft.with_sector(panel.filter(F.col("ticker") != src.MARKET), src.supplier_universe(spark, d))
    return rounded(sc.screener(panel, positions(spark, d, bars=daily)))


@query
def ticker_regression_report(spark, d):
    return rounded(sc.regression_report(src.score_panel(spark, d)))


# folds and splits

@query
def purged_folds_row(spark, d):
    return rounded(cv.fold_summary(cv.fold_roles(scored(spark, d), unit="row")))


@query
def purged_folds_date(spark, d):
    return rounded(cv.fold_roles(scored(spark, d).select("date", "ticker"), unit="date"))


@query
def fold_leakage(spark, d):
    return rounded(cv.fold_leakage(scored(spark, d)))


@query
def split_summary(spark, d):
    used = ["predicted_score", "realized_vol_20", "absent_feature"]
    rows, used, _ = cv.training_rows(src.score_panel(spark, d), used, "fwd_raw_return", ["S1", "S2"])
    train, test = cv.time_split(rows, TRAIN_END, TEST_START)
    return rounded(cv.split_summary(train, test, len(used)))


@query
def purged_boundary_split(spark, d):
    rows, used, _ = cv.training_rows(src.score_panel(spark, d), ["predicted_score"], "fwd_raw_return")
    train, test = cv.time_split(rows, TRAIN_END, TEST_START, purge_boundary=5)
    return rounded(cv.split_summary(train, test, len(used)))


# sources and sinks: written to the work folder and read back

def _folder(spark) -> str:
    return f"{work_dir(spark)}/sink-{uuid.uuid4().hex}"


@query
def bars_store(spark, d):
    """Bars by year, and a range of days read back."""
    path = _folder(spark)
    sk.write_bars(src.stored_bars(spark, d), path)
    return rounded(sb.read_bars(spark, path, START, END))


@query
def vendor_bars(spark, d):
    """Events in a vendor's columns: the first of a user's day stays."""
    events = src.table(spark, d, "events")
    vendor = events.select(F.col("user_id").alias("Ticker"), F.col("ts").alias("Datetime"), F.col("value").alias("Open"),
                           (F.col("value") + 1).alias("HIGH"), F.col("value").alias("close"), F.lit(1).alias("Volume"), "event_type")
    return rounded(sb.normalise_bars(vendor))


@query
def universe_store(spark, d):
    """The universe document written and read back."""
    path = _folder(spark)
    sk.write_json(un.universe_document(src.supplier_universe(spark, d), BENCHMARKS, START, END), path)
    return rounded(un.read_universe(spark, path))


@query
def panel_store(spark, d):
    path = _folder(spark)
    sk.write_panel(lb.daily_return(src.daily_bars(spark, d)), path)
    return columns(spark.read.parquet(path), "daily_return")


@query
def csv_store(spark, d):
    """The daily table of a portfolio as CSV."""
    path = _folder(spark)
    table = daily_table(spark, d)
    sk.write_csv(table, path)
    return rounded(spark.read.option("header", True).schema(table.schema).csv(path))


@query
def missing_tickers(spark, d):
    """Suppliers without a bar on one day."""
    return sb.missing_tickers(src.supplier_universe(spark, d), src.daily_bars(spark, d, START, START))


# exponentially weighted means of other spans

SPANS = (2, 5, 50, 200, 2000)


@query
def ewm_spans(spark, d):
    """Means of five spans and of weight 1/50."""
    specs = {f"ewm_{n}": ("close", ew.span_alpha(n)) for n in SPANS} | {"ewm_a50": ("close", 1 / 50)}
    return columns(ew.ewm(src.daily_bars(spark, d), specs), *specs)


@query
def ewm_with_gaps(spark, d):
    """A mean over bars with null prices."""
    return columns(ew.ewm(src.holey_bars(spark, d), {"ewm_20": ("close", ew.span_alpha(20))}), "ewm_20")


#: Weights so steep that a mean is nearly its last values.
STEEP = {"ewm_a90": 0.9, "ewm_a999": 0.999, "ewm_a1": 1.0}


@query
def ewm_steep(spark, d):
    """Means of weights near 1 over bars with null prices."""
    specs = {n: ("close", a) for n, a in STEEP.items()}
    return columns(ew.ewm(src.holey_bars(spark, d), specs), *specs)


@query
def rsi_50(spark, d):
    return columns(ft.rsi(src.daily_bars(spark, d), 50, name="rsi_50"), "rsi_50")


@query
def macd_50_100(spark, d):
    return columns(ft.macd(src.daily_bars(spark, d), 50, 100, 9), "macd", "macd_signal", "macd_hist")


# models (trees have rows only: no SQL form; least squares has one)

TREES = {"max_depth": 4, "learning_rate": 0.1, "n_estimators": 10, "feature_fraction": 0.8,
         "bagging_fraction": 0.8, "min_child_samples": 20}


def least_squares(features, target):
    def estimator(params):
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x"), LinearRegression(
            featuresCol="__x", labelCol=target, predictionCol="predicted_score", solver="normal", standardization=False)])
    return estimator


def linear_rows(panel):
    rows, _, _ = cv.training_rows(panel, ["predicted_score"], "fwd_raw_return")
    return materialize(rows.select("date", "ticker", "fwd_raw_return", F.col("predicted_score").alias("momentum")))


@query
def cv_rmse_linear(spark, d):
    """Error and row counts of least squares on momentum in each purged fold."""
    rows = linear_rows(src.score_panel(spark, d))
    found = md.search(rows, ["momentum"], [{}], "fwd_raw_return", estimator=least_squares(["momentum"], "fwd_raw_return"))
    return rounded(found.select("fold", "rmse", "n_train", "n_test"))


@query
def scores_linear(spark, d):
    """Scores of least squares fitted before the test period; null without momentum."""
    stored = src.score_panel(spark, d)
    train, _ = cv.time_split(linear_rows(stored), TRAIN_END, TEST_START)
    model = least_squares(["momentum"], "fwd_raw_return")({}).fit(train)
    panel = stored.select("ticker", "date", F.col("predicted_score").alias("momentum"))
    return columns(md.score(model, panel, ["momentum"]), "predicted_score")


@query
def scores_object(spark, d):
    """The same scores by an object with ``predict`` that was fitted from sums."""
    stored = src.score_panel(spark, d)
    train, _ = cv.time_split(linear_rows(stored), TRAIN_END, TEST_START)
    model = ln.ridge_fit(train, ["momentum"], "fwd_raw_return")
    panel = stored.select("ticker", "date", F.col("predicted_score").alias("momentum"))
    return columns(md.score_object(model, panel, ["momentum"]), "predicted_score")


#: Six sets of features, each with five penalties.
RIDGE_FEATURES = ["predicted_score", "realized_vol_20", "daily_return"]
RIDGE_SETS = [[0], [1], [2], [0, 1], [0, 2], [1, 2]]
RIDGE_REGS = [0.0, 1e-5, 1e-4, 1e-3, 1e-2]
RIDGE = [{"features": [RIDGE_FEATURES[i] for i in s], "reg": r} for s in RIDGE_SETS for r in RIDGE_REGS]


@query
def linear_search(spark, d):
    """Errors of 30 settings of ridge regression in each of five purged folds."""
    found = ln.ridge_search(src.score_panel(spark, d), RIDGE, "fwd_raw_return")
    return rounded(found.select("candidate", "fold", "rmse", "n_train", "n_test"))


@query
def best_linear(spark, d):
    """The 30 settings by their mean error."""
    found = md.best_candidate(ln.ridge_search(src.score_panel(spark, d), RIDGE, "fwd_raw_return"))
    return rounded(found.select("candidate", "mean_rmse"))



def training_set(panel):
    """Rows before the test period, stored with what a model reads, and the features."""
    rows, used, _ = cv.training_rows(panel, exclude_tickers=[src.MARKET])
    train, _ = cv.time_split(rows, TRAIN_END, TEST_START)
    return stored(train.select("ticker", "date", TARGET, *used)), used


def fitted(panel):
    train, used = training_set(panel)
    return used, md.regressor(TREES, used, categories=md.n_categories(train)).fit(train)


@query
def model_scores(spark, d):
    panel = stored(md.model_columns(src.model_panel(spark, d), ["ticker", "date", "fwd_raw_return"]))
    used, model = fitted(panel)
    return rounded(md.score(model, panel, used).select("ticker", "date", "predicted_score", "fwd_raw_return"))


@query
def feature_importance(spark, d):
    used, model = fitted(src.model_panel(spark, d))
    return rounded(md.importances(model, used))


@query
def cv_search(spark, d):
    train, used = training_set(src.model_panel(spark, d))
    space = {"max_depth": [2, 3], "learning_rate": [0.05, 0.1], "n_estimators": [3], "min_child_samples": [20]}
    results = md.search(train, used, md.sample_candidates(space, 2))
    return rounded(md.best_candidate(results))
