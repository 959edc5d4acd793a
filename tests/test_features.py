import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from conftest import BAR_DDL, bars_pdf, close_to, days, frame, plan, result

from panelspark.functions import ewm as ew
from panelspark.operators import features as ft
from panelspark.operators import labels as lb
from panelspark.sources import universe as un


def wilder(close, period):
    delta = close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / period, min_periods=period, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / period, min_periods=period, adjust=False).mean()
    return (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(50)


def expected(g):
    """The definitions in pandas."""
    o, h, l, c, v, r = g.open, g.high, g.low, g.close, g.volume, g.close.pct_change()
    hl2, co2 = np.log(h / l) ** 2, np.log(c / o) ** 2
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    sma, dev = c.rolling(20).mean(), c.rolling(20).std()
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    signal = line.ewm(span=9, adjust=False).mean()
    out = {
        "amihud_illiq_20": (r.abs() / (c * v) * 1e6).rolling(20).mean(), "atr_20": tr.rolling(20).mean(),
        "vol_regime": tr.rolling(20).mean() / tr.rolling(200).mean(),
        "volume_zscore": (v - v.rolling(20).mean()) / v.rolling(20).std(),
        "close_to_sma20": c / sma, "rsi_14": wilder(c, 14), "macd": line, "macd_signal": signal, "macd_hist": line - signal,
        "bb_upper": sma + 2 * dev, "bb_lower": sma - 2 * dev, "bb_width": 4 * dev / sma, "hl_spread": (h - l) / c,
        "volume_sma_10": v.rolling(10).mean(), "volume_change": v.pct_change(), "dollar_volume": c * v,
    }
    for n in (10, 20):
        out[f"parkinson_vol_{n}"] = np.sqrt(hl2.rolling(n).mean() / (4 * np.log(2)))
        out[f"garman_klass_vol_{n}"] = np.sqrt((0.5 * hl2 - (2 * np.log(2) - 1) * co2).rolling(n).mean().clip(lower=0))
        out[f"realized_vol_{n}"] = r.rolling(n).std()
    for n in (10, 20, 50):
        out[f"sma_{n}"] = c.rolling(n).mean()
    for k in (1, 2, 3, 5):
        out[f"return_lag_{k}"] = r.shift(k)
    for k in (5, 10, 20):
        out[f"momentum_{k}"] = c.pct_change(k)
    return pd.DataFrame(out)


def test_all_features_against_pandas(spark):
    pdf = bars_pdf(["A", "B"], 230)
    universe = un.from_sector_lists(spark, {"X": ["Q"], "Y": ["A"]})
    panel = lb.daily_return(frame(spark, pdf, BAR_DDL))
    got = result(ft.engineer_features(panel, universe), "ticker", "date")
    for t, g in pdf.groupby("ticker"):
        want = expected(g.reset_index(drop=True))
        mine = got[got.ticker == t].reset_index(drop=True)
        assert set(want.columns) == set(ft.FEATURES)
        for c in want.columns:
            close_to(mine[c], want[c], 1e-8)
    codes = dict(zip(got.ticker, got.sector_code))
    assert codes == {"A": 1, "B": -1} and set(got[got.ticker == "B"].sector) == {"Unknown"}


def test_single_features_agree_with_the_panel(spark):
    panel = lb.daily_return(frame(spark, bars_pdf(["A"], 60), BAR_DDL))
    whole = result(ft.engineer_features(panel), "date")
    tr = ft.vol_regime(panel.withColumn("true_range", ft.true_range()), 5, 40)
    assert tr.filter("vol_regime is not null").count() == 21
    one = result(ft.macd(ft.rsi(ft.bollinger(panel))).withColumns({
        "p": ft.parkinson(20), "g": ft.garman_klass(10), "z": ft.volume_zscore(20)}), "date")
    for a, b in (("rsi_14", "rsi_14"), ("macd_signal", "macd_signal"), ("bb_width", "bb_width"),
                 ("p", "parkinson_vol_20"), ("g", "garman_klass_vol_10"), ("z", "volume_zscore")):
        close_to(one[a], whole[b])


def test_zero_divisors_and_flat_prices(spark):
    rows = [("A", d, 10.0, 10.0, 10.0, 10.0, 0.0) for d in days(30)]
    got = result(ft.engineer_features(lb.daily_return(frame(spark, rows, BAR_DDL))), "date")
    assert got.volume_change.isna().all() and got.amihud_illiq_20.isna().all() and got.volume_zscore.isna().all()
    assert (got.rsi_14 == 50).all() and (got.macd.abs() < 1e-12).all()
    assert (got.parkinson_vol_10.dropna() == 0).all() and (got.bb_width.dropna() == 0).all()


def test_rising_prices_keep_rsi_at_fifty(spark):
    rows = [("A", d, 1.0, 2.0, 1.0, float(i + 1), 1.0) for i, d in enumerate(days(40))]
    assert (result(ft.rsi(frame(spark, rows, BAR_DDL)), "date").rsi_14 == 50).all()


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 10, 2 / 27])
def test_ewm_with_leading_nulls(spark, alpha):
    x = [np.nan, np.nan] + np.random.RandomState(1).randn(50).tolist()
    pdf = pd.DataFrame({"ticker": "A", "date": days(52), "x": x})
    got = result(ew.ewm(frame(spark, pdf, "ticker string, date date, x double"), {"y": ("x", alpha)}, {"y": 3}), "date").y
    close_to(got, pdf.x.ewm(alpha=alpha, adjust=False, min_periods=3).mean())


def test_ewm_over_many_blocks(spark):
    n = 6000
    rng = np.random.RandomState(2)
    x = rng.randn(n) + np.where(np.arange(n) < 3000, 1e6, 0.0)
    pdf = pd.DataFrame({"ticker": "A", "date": days(n, "1990-01-01"), "x": x})
    df = frame(spark, pdf, "ticker string, date date, x double")
    got = result(ew.ewm(df, {"y": ("x", 2 / 13), "z": ("x", 0.2)}), "date")
    close_to(got.y, pdf.x.ewm(span=12, adjust=False).mean(), 1e-9)
    close_to(got.z, pdf.x.ewm(alpha=0.2, adjust=False).mean(), 1e-9)


@pytest.mark.parametrize("span", [1, 2, 5, 50, 200, 2000])
def test_ewm_of_any_span_with_gaps(spark, span):
    rng = np.random.RandomState(span)
    x = pd.Series(100 + rng.randn(3000).cumsum())
    x[rng.rand(3000) < 0.2] = np.nan
    x[700:1900] = np.nan
    x[:3] = np.nan
    pdf = pd.DataFrame({"ticker": "A", "date": days(3000, "1990-01-01"), "x": x})
    df = frame(spark, pdf, "ticker string, date date, x double")
    got = result(ew.ewm(df, {"y": ("x", ew.span_alpha(span)), "z": ("x", 1 / 50)}, {"y": 4}), "date")
    close_to(got.y, x.ewm(span=span, adjust=False, min_periods=4).mean(), 1e-9)
    close_to(got.z, x.ewm(alpha=1 / 50, adjust=False).mean(), 1e-9)


def test_ewm_of_a_constant_with_a_null_is_the_constant(spark):
    rows = [("A", d, None if i == 5 else 100.0) for i, d in enumerate(days(40))]
    got = result(ew.ewm(frame(spark, rows, "ticker string, date date, x double"), {"y": ("x", 0.1)}), "date").y
    close_to(got, [100.0] * 40)


def test_ewm_weights(spark):
    df = frame(spark, [("A", days(1)[0], 1.0)], "ticker string, date date, x double")
    for alpha in (0.0, 1.1):
        with pytest.raises(ValueError):
            ew.ewm(df, {"y": ("x", alpha)})


@pytest.mark.parametrize("period", [2, 50])
def test_long_rsi_and_macd(spark, period):
    rng = np.random.RandomState(4)
    c = pd.Series(100 + rng.randn(400).cumsum())
    pdf = pd.DataFrame({"ticker": "A", "date": days(400), "close": c})
    df = frame(spark, pdf, "ticker string, date date, close double")
    delta = c.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / period, min_periods=period, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / period, min_periods=period, adjust=False).mean()
    close_to(result(ft.rsi(df, period, name="r"), "date").r, (100 - 100 / (1 + gain / loss)).fillna(50), 1e-8)
    line = c.ewm(span=50, adjust=False).mean() - c.ewm(span=100, adjust=False).mean()
    got = result(ft.macd(df, 50, 100, 5), "date")
    close_to(got.macd_signal, line.ewm(span=5, adjust=False).mean(), 1e-8)


def test_frames_longer_than_a_block(spark, monkeypatch):
    from panelspark.functions import rolling

    monkeypatch.setattr(rolling, "BLOCK", 16)
    x = pd.Series(np.random.RandomState(5).randn(200))
    df = frame(spark, pd.DataFrame({"ticker": "A", "date": days(200), "x": x}), "ticker string, date date, x double")
    for n in (10, 16, 40):
        got = result(rolling.long_sums(rolling.in_blocks(df, 16), n, {"s": F.col("x")}), "date")
        close_to(got.s, x.rolling(n, min_periods=1).sum(), 1e-9)
        assert "__block" in got.columns


def steep_frame(spark, n):
    x = pd.Series(100 + np.random.RandomState(5).randn(n).cumsum())
    x[np.random.RandomState(6).rand(n) < 0.1] = np.nan
    x[300:1500] = np.nan
    dates = pd.date_range("1900-01-01", periods=n).date
    return x, frame(spark, pd.DataFrame({"ticker": "A", "date": dates, "x": x}), "ticker string, date date, x double")


@pytest.mark.parametrize("fan, top", [(32, 65_536), (2, 1024), (4, 65_536)])
def test_ewm_of_steep_weights(spark, fan, top, monkeypatch):
    monkeypatch.setattr(ew, "FAN", fan)
    monkeypatch.setattr(ew, "TREE_ROWS", top)
    x, df = steep_frame(spark, 6000)
    alphas = [0.9, 0.999, 1.0] if fan != 4 else [0.9]
    got = result(ew.ewm(df, {f"y{i}": ("x", a) for i, a in enumerate(alphas)}, {"y0": 3}), "date")
    for i, a in enumerate(alphas):
        close_to(got[f"y{i}"], x.ewm(alpha=a, adjust=False, min_periods=0 if i else 3).mean(), 1e-9)


def test_rows_hold_few_maps_whatever_the_weight():
    for alpha in (0.25, 0.5, 0.9, 0.999, 1 - 1e-12):
        rows = ew.block_rows(alpha)
        assert rows >= ew.BLOCK or rows * ew.FAN ** ew.tree_levels(rows) >= ew.TREE_ROWS
    assert ew.tree_levels(ew.BLOCK) == 0


def test_both_forms_of_ewm_agree_and_series_needs_no_window(spark):
    x, df = steep_frame(spark, 3000)
    specs = {"a": ("x", 0.9), "b": ("x", ew.span_alpha(200)), "c": ("x", 1.0)}
    by_series, by_windows = (ew.ewm(df, specs, {"b": 9}, form=f) for f in ("series", "windows"))
    one, other = result(by_series, "date"), result(by_windows, "date")
    for n in specs:
        close_to(one[n], other[n], 1e-9)
    text = by_series._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "Window [" not in text  # no task holds its rows many times over


@pytest.mark.parametrize("rows, batch", [(1, 7), (300, 100), (16_384, 10_000)])
def test_features_of_whole_tickers_in_batches(spark, rows, batch, monkeypatch):
    """Tickers of uneven length, gaps in volume and prices, flat prices; cut into batches at any place."""
    pdf = pd.concat([bars_pdf([t], n, seed=n) for t, n in (("A", 230), ("B", 1), ("C", 15), ("D", 60), ("E", 400))], ignore_index=True)
    pdf.loc[::37, "volume"] = 0.0
    pdf.loc[5::53, ["open", "high", "low", "close"]] = np.nan
    pdf.loc[pdf.ticker == "D", ["open", "high", "low", "close", "volume"]] = 10.1
    panel = lb.daily_return(frame(spark, pdf, BAR_DDL))
    universe = un.from_sector_lists(spark, {"X": ["Q"], "Y": ["A"]})
    want = result(ft.engineer_features(panel, universe), "ticker", "date")
    monkeypatch.setattr(ew.per_run, "__defaults__", (*ew.per_run.__defaults__[:-1], rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = result(ft.engineer_features(panel, universe, form="series"), "ticker", "date")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(got.columns) == list(want.columns) and (got.sector_code == want.sector_code).all()
    for c in ft.FEATURES:
        close_to(got[c], want[c], 1e-8)
    assert got[got.ticker == "D"].volume_zscore.isna().all()
    text = plan(ft.engineer_features(panel, form="series"))
    assert text.count("Window [") == 1 and "MapInArrow" in text  # the return's
