"""Per-ticker features: volatility, liquidity, technical indicators, lags and sectors."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ewm import ewm, mean_of, per_run, per_series, span_alpha
from panelspark.functions.rolling import as_col, before, block_windows, change, div, frame_means, frame_stds, in_blocks, long_sums, mean, series, std

LN2 = math.log(2.0)
MACD = ["macd", "macd_signal", "macd_hist"]
#: What the features of a ticker are made of.
BAR_INPUTS = ["open", "high", "low", "close", "volume", "daily_return"]

FEATURES = [
    "dollar_volume",
    "parkinson_vol_10", "parkinson_vol_20", "garman_klass_vol_10", "garman_klass_vol_20",
    "amihud_illiq_20", "atr_20", "vol_regime", "volume_zscore",
    "sma_10", "sma_20", "sma_50", "close_to_sma20", "rsi_14",
    "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width",
    "realized_vol_10", "realized_vol_20", "hl_spread", "volume_sma_10", "volume_change",
    "return_lag_1", "return_lag_2", "return_lag_3", "return_lag_5",
    "momentum_5", "momentum_10", "momentum_20",
]


def _log_ratio(a, b) -> Column:
    return F.log(div(a, b))


def parkinson(n: int = 20, high="high", low="low") -> Column:
    r = _log_ratio(high, low)
    return F.sqrt(mean(r * r, n) / F.lit(4 * LN2))


def garman_klass(n: int = 20, open_="open", high="high", low="low", close="close") -> Column:
    hl, co = _log_ratio(high, low), _log_ratio(close, open_)
    term = F.lit(0.5) * hl * hl - F.lit(2 * LN2 - 1) * co * co
    return _root(mean(term, n))


def _root(level: Column) -> Column:
    """Square root of a mean that may be negative (taken as 0); ``greatest`` alone would hide nulls."""
    return F.when(level.isNotNull(), F.sqrt(F.greatest(level, F.lit(0.0))))


def amihud(n: int = 20, ret="daily_return", dollar_volume="dollar_volume") -> Column:
    return mean(div(F.abs(as_col(ret)), dollar_volume) * 1e6, n)


def true_range(high="high", low="low", close="close", w=None) -> Column:
    """The largest of three ranges; ``greatest`` skips the nulls of a ticker's first row."""
    h, l, before = as_col(high), as_col(low), F.lag(close).over(w if w is not None else series())
    return F.greatest(h - l, F.abs(h - before), F.abs(l - before))


def atr(n: int = 20, tr="true_range") -> Column:
    return mean(tr, n)


def vol_regime(df: DataFrame, short: int = 20, long: int = 200, tr="true_range") -> DataFrame:
    """Add vol_regime, short over long average true range; the long frame is a block sum."""
    out = long_sums(df, long, {"__n": F.when(F.col(tr).isNotNull(), 1.0), "__sum": F.col(tr)})
    slow = F.when(F.col("__n") == long, F.col("__sum") / F.lit(float(long)))
    return out.withColumn("vol_regime", div(atr(short, tr), slow)).select(*df.columns, "vol_regime")


def volume_zscore(n: int = 20, volume="volume") -> Column:
    return div(as_col(volume) - mean(volume, n), std(volume, n))


def rsi(df: DataFrame, period: int = 14, close="close", name="rsi_14") -> DataFrame:
    """Wilder's index; 50 while warming up and where there was no loss."""
    return per_series(df, [name], [close], lambda x: {name: _rsi_of(x[close], period)}).select(*[c for c in df.columns if c != name], name)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, close="close") -> DataFrame:
    """MACD line, its signal and the difference."""
    return per_series(df, MACD, [close], lambda x: _macd_of(x[close], fast, slow, signal))


def _numbers(at: np.ndarray | None) -> np.ndarray | None:
    """The number of the series of each row, from the places in them."""
    return None if at is None else np.cumsum(at == 0)


def _rsi_of(close: pd.Series, period: int, at: np.ndarray = None) -> np.ndarray:
    moved = close.diff() if at is None else close.diff().where(at > 0)
    gain, loss = (mean_of(m.clip(lower=0), 1.0 / period, period, _numbers(at)).to_numpy() for m in (moved, -moved))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100.0 - 100.0 / (1.0 + gain / loss)
    return np.where(loss > 0, value, 50.0)


def _macd_of(close: pd.Series, fast: int, slow: int, signal: int, at: np.ndarray = None) -> dict:
    of = _numbers(at)
    line = mean_of(close, span_alpha(fast), of=of) - mean_of(close, span_alpha(slow), of=of)
    mean_line = mean_of(line, span_alpha(signal), of=of)
    return {"macd": line, "macd_signal": mean_line, "macd_hist": line - mean_line}


def momentum_indicators(df: DataFrame) -> DataFrame:
    """RSI and MACD with the standard periods in one chain: the four averages share the windows of the other features."""
    alpha = 1.0 / 14
    out = _gains_and_losses(in_blocks(df), "close")
    out = ewm(out, {
        "__avg_gain": ("__gain", alpha), "__avg_loss": ("__loss", alpha),
        "__fast": ("close", span_alpha(12)), "__slow": ("close", span_alpha(26)),
    }, min_periods={"__avg_gain": 14, "__avg_loss": 14}, form="windows")
    out = out.withColumns({
        "rsi_14": _rsi_value(),
        "macd": F.col("__fast") - F.col("__slow"),
    })
    out = ewm(out, {"macd_signal": ("macd", span_alpha(9))}, form="windows")
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")) \
        .select(*df.columns, "rsi_14", "macd", "macd_signal", "macd_hist")


def _gains_and_losses(df: DataFrame, close) -> DataFrame:
    w = block_windows()[0] if "__block" in df.columns else series()
    delta = F.col(close) - F.lag(close).over(w)
    return df.withColumn("__delta", delta).withColumns({
        "__gain": F.when(F.col("__delta").isNotNull(), F.greatest(F.col("__delta"), F.lit(0.0))),
        "__loss": F.when(F.col("__delta").isNotNull(), F.greatest(-F.col("__delta"), F.lit(0.0))),
    })


def _rsi_value() -> Column:
    rs = div("__avg_gain", "__avg_loss")
    return F.coalesce(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs), F.lit(50.0))


def moving_averages(windows=(10, 20, 50), close="close", w=None) -> dict:
    return {f"sma_{n}": mean(close, n, w) for n in windows}


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, close="close") -> DataFrame:
    mid, dev = mean(close, n), std(close, n)
    return df.withColumns({"__mid": mid, "__dev": dev}).withColumns({
        "bb_upper": F.col("__mid") + k * F.col("__dev"),
        "bb_lower": F.col("__mid") - k * F.col("__dev"),
    }).withColumn("bb_width", div(F.col("bb_upper") - F.col("bb_lower"), "__mid")).drop("__mid", "__dev")


def realized_vol(n: int = 20, ret="daily_return", w=None) -> Column:
    return std(ret, n, w)


def hl_spread() -> Column:
    return div(F.col("high") - F.col("low"), "close")


def return_lags(lags=(1, 2, 3, 5), ret="daily_return", w=None) -> dict:
    return {f"return_lag_{k}": F.lag(ret, k).over(w if w is not None else series()) for k in lags}


def momentum(lags=(5, 10, 20), close="close", w=None) -> dict:
    return {f"momentum_{k}": change(close, k, w) for k in lags}


def with_sector(df: DataFrame, universe: DataFrame, small: bool = False) -> DataFrame:
    """Add sector and sector_code, 'Unknown' and -1 where the ticker is not listed.

    Spark broadcasts the universe when its statistics say it is small; set ``small`` for a list that
    is known to be.
    """
    dim = F.broadcast(universe) if small else universe
    joined = df.join(dim.select("ticker", "sector", "sector_code"), "ticker", "left")
    return joined.withColumns({
        "sector": F.coalesce("sector", F.lit("Unknown")),
        "sector_code": F.coalesce("sector_code", F.lit(-1)).cast("int"),
    })


def _ratio(a, b) -> np.ndarray:
    """Division of a series; a zero divisor gives NaN."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return np.divide(a, b, out=np.full(len(b), np.nan), where=b != 0)


def _features_of(bars: pd.DataFrame, at: np.ndarray, short: int, long: int) -> dict:
    """The features of tickers, one after the other and in order of time; ``at`` is a row's place in its ticker. NaN is missing."""
    open_, high, low, close, volume, ret = (bars[c].to_numpy() for c in BAR_INPUTS)
    means, stds = (lambda n, *x, f=f: f(np.stack(x), n, at) for f in (frame_means, frame_stds))
    with np.errstate(divide="ignore", invalid="ignore"):
        hl, co = (np.log(np.where(x > 0, x, np.nan)) for x in (_ratio(high, low), _ratio(close, open_)))
        last, dollars = before(close, 1, at), close * volume
        ranges = np.fmax(high - low, np.fmax(np.abs(high - last), np.abs(low - last)))
        garman = 0.5 * hl * hl - (2 * LN2 - 1) * co * co
        pk, gk, sma, v_mean = {}, {}, {}, {}
        pk[10], gk[10], sma[10], v_mean[10] = means(10, hl * hl, garman, close, volume)
        pk[20], gk[20], sma[20], v_mean[20], illiq = means(20, hl * hl, garman, close, volume, _ratio(np.abs(ret), dollars) * 1e6)
        (sma[50],), (atr,), (slow,) = means(50, close), means(short, ranges), means(long, ranges)
        (v_std, bb_std, vol_20), (vol_10,) = stds(20, volume, close, ret), stds(10, ret)
        upper, lower = sma[20] + 2 * bb_std, sma[20] - 2 * bb_std
        return {
            "dollar_volume": dollars,
            **{f"parkinson_vol_{n}": np.sqrt(x / (4 * LN2)) for n, x in pk.items()},
            **{f"garman_klass_vol_{n}": np.sqrt(np.maximum(x, 0.0)) for n, x in gk.items()},
            "amihud_illiq_20": illiq, "atr_20": atr, "vol_regime": _ratio(atr, slow),
            "volume_zscore": _ratio(volume - v_mean[20], v_std),
            **{f"sma_{n}": x for n, x in sma.items()}, "close_to_sma20": _ratio(close, sma[20]),
            "rsi_14": _rsi_of(bars["close"], 14, at), **_macd_of(bars["close"], 12, 26, 9, at),
            "bb_upper": upper, "bb_lower": lower, "bb_width": _ratio(upper - lower, sma[20]),
            "realized_vol_10": vol_10, "realized_vol_20": vol_20, "hl_spread": _ratio(high - low, close),
            "volume_sma_10": v_mean[10], "volume_change": _ratio(volume, before(volume, 1, at)) - 1,
            **{f"return_lag_{k}": before(ret, k, at) for k in (1, 2, 3, 5)},
            **{f"momentum_{k}": _ratio(close, before(close, k, at)) - 1 for k in (5, 10, 20)},
        }


def engineer_features(panel: DataFrame, universe: DataFrame = None, short: int = 20, long: int = 200, form: str = "windows",
                      beside=None, parts: int = None) -> DataFrame:
    """All features of a panel that has daily_return.

    Form "series" computes the features of whole tickers from Arrow batches (see ``per_run``): one exchange and one sort of the
    narrow rows, and memory for some thousand rows or one longer ticker. The sectors join before, as a join of the wide result may
    exchange it. A NaN counts as missing. ``beside`` gives names, inputs and compute of more columns of the same pass, ``parts`` the
    number of parts (see ``per_run``).

    Form "windows" stays in the JVM. Every window is partitioned by ticker, so it costs one exchange (none when the input is
    partitioned that way) and two sorts: by date, to number the blocks, and by block and date. Both come
    first, while rows are narrow; the long memories follow and the many short frames come last.
    """
    if form == "series":
        names, inputs, more = beside or ([], [], lambda x, at: {})
        df = with_sector(panel, universe) if universe is not None else panel
        return per_run(df, [*names, *FEATURES], [*BAR_INPUTS, *inputs], lambda x, at: more(x, at) | _features_of(x, at, short, long), parts=parts)
    if form != "windows":
        raise ValueError(f"unknown form {form!r}")
    df = with_sector(panel, universe) if universe is not None else panel
    keep = df.columns
    hl, co = _log_ratio("high", "low"), _log_ratio("close", "open")
    df = in_blocks(df)
    w = block_windows()[0]
    df = df.withColumn("__tr", true_range(w=w))
    df = long_sums(df, long, {"__n": F.when(F.col("__tr").isNotNull(), 1.0), "__tr_sum": F.col("__tr")})
    df = momentum_indicators(df).withColumns({
        "dollar_volume": F.col("close") * F.col("volume"), "__hl2": hl * hl,
        "__gk": F.lit(0.5) * hl * hl - F.lit(2 * LN2 - 1) * co * co,
    })
    df = df.withColumn("__illiq", div(F.abs("daily_return"), "dollar_volume") * 1e6)
    df = df.withColumns({
        **{f"__pk_{n}": mean("__hl2", n, w) for n in (10, 20)},
        **{f"__gk_{n}": mean("__gk", n, w) for n in (10, 20)},
        "amihud_illiq_20": mean("__illiq", 20, w), "atr_20": mean("__tr", short, w),
        "__v_mean": mean("volume", 20, w), "__v_std": std("volume", 20, w),
        **moving_averages(w=w), "__bb_std": std("close", 20, w),
        "realized_vol_10": realized_vol(10, w=w), "realized_vol_20": realized_vol(20, w=w),
        "volume_sma_10": mean("volume", 10, w), "volume_change": change("volume", 1, w),
        **return_lags(w=w), **momentum(w=w),
    })
    slow = F.when(F.col("__n") == long, F.col("__tr_sum") / F.lit(float(long)))
    df = df.withColumns({
        **{f"parkinson_vol_{n}": F.sqrt(F.col(f"__pk_{n}") / F.lit(4 * LN2)) for n in (10, 20)},
        **{f"garman_klass_vol_{n}": _root(F.col(f"__gk_{n}")) for n in (10, 20)},
        "volume_zscore": div(F.col("volume") - F.col("__v_mean"), "__v_std"),
        "close_to_sma20": div("close", "sma_20"),
        "hl_spread": hl_spread(),
        "bb_upper": F.col("sma_20") + 2 * F.col("__bb_std"),
        "bb_lower": F.col("sma_20") - 2 * F.col("__bb_std"),
        "vol_regime": div("atr_20", slow),
    })
    return df.withColumn("bb_width", div(F.col("bb_upper") - F.col("bb_lower"), "sma_20")).select(*keep, *FEATURES)
