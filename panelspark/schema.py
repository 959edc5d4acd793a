"""Schemas, column lists and default parameters."""

from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]

UNIVERSE_DOCUMENT = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("n_tickers", T.LongType()),
    T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("benchmarks", T.ArrayType(T.StringType())),
    T.StructField("sectors", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("sector_map", T.MapType(T.StringType(), T.StringType())),
])

# The model's feature columns, in model order.
FEATURE_COLUMNS = [
    "parkinson_vol_10", "parkinson_vol_20",
    "garman_klass_vol_10", "garman_klass_vol_20",
    "amihud_illiq_20", "atr_20", "vol_regime", "volume_zscore",
    "fracdiff_close",
    "close_to_sma20", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_width",
    "realized_vol_10", "realized_vol_20", "hl_spread",
    "volume_sma_10", "volume_change",
    "return_lag_1", "return_lag_2", "return_lag_3", "return_lag_5",
    "momentum_5", "momentum_10", "momentum_20",
    "sector_code", "rolling_beta",
]

# Columns a model must never see.
EXCLUDE_COLUMNS = [
    "date", "ticker", "open", "high", "low", "close", "volume",
    "daily_return", "market_return", "rolling_alpha", "residual_return",
    "fwd_residual_return", "fwd_raw_return",
    "log_close", "fracdiff_d", "dollar_volume", "sector",
]

# Study defaults.
TARGET = "fwd_residual_return"
BETA_WINDOW = 252
LABEL_HORIZON = 5
REBALANCE_FREQ = 5
N_QUANTILES = 5
COST_BPS = 8.0
TRADING_DAYS = 252
MIN_HISTORY = 500
MIN_STOCKS = 10
D_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
FFD_THRESH = 1e-5
FFD_MAX_SIZE = 1000
ADF_P = 0.05
MIN_ADF_ROWS = 50
TRAIN_END = "2022-12-31"
TEST_START = "2023-01-01"
BENCHMARKS = ["SPY", "QQQ"]


def available_features(columns, wanted=None):
    """Split the wanted feature columns into those present and those missing, keeping their order."""
    wanted = FEATURE_COLUMNS if wanted is None else wanted
    present = set(columns)
    return [c for c in wanted if c in present], [c for c in wanted if c not in present]
