import numpy as np
import pandas as pd
from conftest import BAR_DDL, bars_pdf, close_to, day, days, frame, result
from pyspark.sql import functions as F

from panelspark.operators import labels as lb


def test_label_panel_against_pandas(spark):
    pdf = bars_pdf(["A", "B", "MKT"], 90)
    pdf = pdf[~((pdf.ticker == "A") & (pdf.date == days(90)[7]))]
    got = result(lb.label_panel(frame(spark, pdf, BAR_DDL), "MKT", window=20, horizon=5), "ticker", "date")
    pdf["r"] = pdf.groupby("ticker").close.pct_change()
    market = pdf[pdf.ticker == "MKT"].set_index("date").r
    for t, g in pdf.groupby("ticker"):
        mine = got[got.ticker == t]
        r, m = g.r.reset_index(drop=True), g.date.map(market).reset_index(drop=True)
        beta = r.rolling(20).cov(m) / m.rolling(20).var()
        alpha = r.rolling(20).mean() - beta * m.rolling(20).mean()
        if t == "MKT":
            beta, alpha = pd.Series(1.0, r.index), pd.Series(0.0, r.index)
        eps = r - (alpha + beta * m)
        close_to(mine.rolling_beta, beta)
        close_to(mine.rolling_alpha, alpha)
        close_to(mine.residual_return, eps)
        close_to(mine.fwd_residual_return, eps.rolling(5).sum().shift(-5))
        close_to(mine.fwd_raw_return, r.rolling(5).sum().shift(-5))


def test_still_market_gives_no_beta(spark):
    n = 30
    rows = [("A", d, 0.01 * (i % 3), 0.002) for i, d in enumerate(days(n))]
    df = frame(spark, rows, "ticker string, date date, daily_return double, market_return double")
    assert lb.market_model(df, 10).filter(F.col("rolling_beta").isNotNull()).count() == 0


def test_beta_over_many_blocks(spark, monkeypatch):
    from panelspark.functions import rolling
    monkeypatch.setattr(rolling, "BLOCK", 16)
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"ticker": "A", "date": days(120), "r": rng.randn(120), "m": rng.randn(120)})
    for window in (3, 10, 16):
        df = frame(spark, pdf, "ticker string, date date, daily_return double, market_return double")
        got = result(lb.market_model(df, window), "date")
        close_to(got.rolling_beta, pdf.r.rolling(window).cov(pdf.m) / pdf.m.rolling(window).var())


def test_forward_sum_is_null_over_a_null(spark):
    rows = [("A", d, None if i == 6 else float(i)) for i, d in enumerate(days(12))]
    df = frame(spark, rows, "ticker string, date date, residual_return double")
    got = result(lb.forward_residual(df, 2), "date").fwd_residual_return
    want = pd.Series([np.nan if i == 6 else float(i) for i in range(12)]).rolling(2).sum().shift(-2)
    close_to(got, want)


def barrier_loop(close, vol, dates, hold, pt=2.0, sl=2.0):
    out = []
    for i, (p, v) in enumerate(zip(close, vol)):
        if i == len(close) - 1 or v is None or v <= 0:
            out.append((0, None))
            continue
        window = list(range(i + 1, min(i + 1 + hold, len(close))))
        hit = next(((1 if close[j] >= p * (1 + pt * v) else -1, dates[j]) for j in window
                    if close[j] >= p * (1 + pt * v) or close[j] <= p * (1 - sl * v)), None)
        out.append(hit or (int(np.sign(close[window[-1]] - p)), dates[window[-1]]))
    return out


def test_triple_barrier_against_a_loop(spark):
    rng = np.random.RandomState(7)
    n = 80
    close = np.round(100 + np.cumsum(rng.choice([-2.0, 0.0, 0.5, 2.0], n)), 1).tolist()
    vol = [None if i % 11 == 3 else 0.0 if i % 13 == 5 else 0.01 for i in range(n)]
    rows = [("A", d, c, v) for d, c, v in zip(days(n), close, vol)]
    got = result(lb.triple_barrier(frame(spark, rows, "ticker string, date date, close double, vol double")), "date")
    want = barrier_loop(close, vol, days(n), 5)
    assert got.barrier_label.tolist() == [w[0] for w in want]
    assert [None if pd.isna(x) else x for x in got.barrier_date] == [w[1] for w in want]


def test_exact_touch_counts(spark):
    rows = [("A", day("2024-01-01"), 100.0, 0.5), ("A", day("2024-01-02"), 200.0, 0.5)]
    df = frame(spark, rows, "ticker string, date date, close double, vol double")
    assert result(lb.triple_barrier(df), "date").barrier_label.tolist() == [1, 0]


def test_coverage(spark):
    df = frame(spark, [("A", 1.0), ("B", None)], "ticker string, fwd_residual_return double")
    assert tuple(lb.label_coverage(df).first()) == (1, 2, 50.0)
