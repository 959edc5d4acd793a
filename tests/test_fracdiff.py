import numpy as np
import pandas as pd
import pytest
from conftest import BAR_DDL, bars_pdf, close_to, days, frame, result, walk

from panelspark.functions import stats
from panelspark.operators import fracdiff as fd

SERIES = "ticker string, date date, log_close double"


def logs(n, ticker="A", seed=42):
    return pd.DataFrame({"ticker": ticker, "date": days(n, "2000-01-03"), "log_close": np.log(walk(n, seed))})


@pytest.mark.parametrize("d", [0.1, 0.3, 0.5, 0.7, 0.9])
def test_weights(d):
    w = fd.ffd_weights(d)
    assert w[0] == 1.0 and len(w) >= 2 and abs(w[1] + d) < 1e-15
    assert len(w) == fd.FFD_MAX_SIZE or abs(w[-1]) >= 1e-5
    if d == 0.5:
        assert all(abs(a) >= abs(b) for a, b in zip(w, w[1:]))


def test_weights_of_whole_orders():
    assert fd.ffd_weights(0.0) == [1.0]
    assert fd.ffd_weights(1.0, 1e-10) == [1.0, -1.0]


def test_both_forms_agree_and_keep_length(spark):
    pdf = pd.concat([logs(150), logs(40, "B", 3), logs(1, "C", 4)])
    df = frame(spark, pdf, SERIES)
    grid = [0.0, 0.4, 0.8, 1.0]
    a = result(fd.ffd(df, grid, thresh=1e-3), "ticker", "date")
    b = result(fd.ffd(df, grid, thresh=1e-3, form="arrays"), "ticker", "date")
    assert len(a) == 191
    for d in grid:
        close_to(a[fd.column_name(d)], b[fd.column_name(d)], 1e-10)
    one = a[a.ticker == "A"]
    close_to(one.ffd_0000, one.log_close)
    close_to(one.ffd_1000[1:], one.log_close.diff()[1:])
    # B is shorter than the filter of d = 0.4 (55 weights): a value on its last row only
    assert a[a.ticker == "B"].ffd_0400.notna().tolist() == [False] * 39 + [True]


def least_squares_stat(x):
    dy, lev, lagged = np.diff(x)[1:], x[1:-1], np.diff(x)[:-1]
    design = np.column_stack([np.ones(len(dy)), lev, lagged])
    beta, *_ = np.linalg.lstsq(design, dy, rcond=None)
    resid = dy - design @ beta
    cov = resid @ resid / (len(dy) - 3) * np.linalg.inv(design.T @ design)
    return beta[1] / np.sqrt(cov[1, 1])


def test_unit_root_statistic_both_ways(spark):
    pdf = pd.concat([logs(500), logs(200, "B", 9), logs(49, "C", 1)])
    got = result(fd.unit_root(frame(spark, pdf, SERIES), ["log_close"]), "ticker")
    want = [least_squares_stat(g.log_close.to_numpy()) for _, g in pdf.groupby("ticker")]
    close_to(got.stat[:2], want[:2], 1e-8)
    assert np.isnan(got.stat[2]) and got.n_obs.tolist() == [500, 200, 49]
    close_to([fd.unit_root_stat(g.log_close.to_numpy()) for _, g in pdf.groupby("ticker")], [*want[:2], np.nan], 1e-8)


def test_constant_series_has_no_test(spark):
    df = frame(spark, [("A", d, 2.0) for d in days(80)], SERIES)
    assert fd.unit_root(df, ["log_close"]).first().stat is None
    assert np.isnan(fd.unit_root_stat(np.full(80, 2.0)))


def test_p_values(spark):
    for stat, p in ((-3.43, 0.00998), (-2.86, 0.0502), (-2.57, 0.0994)):
        assert abs(stats.unit_root_p(stat) - p) < 1e-4
    assert stats.unit_root_p(3.0) == 1.0 and stats.unit_root_p(-19.0) == 0.0
    values = [None, 3.0, -19.0, *np.linspace(-18, 2.7, 60).tolist()]
    got = frame(spark, [(v,) for v in values], "s double").select(stats.unit_root_p_column("s")).collect()
    assert got[0][0] is None and all(abs(g[0] - stats.unit_root_p(v)) < 1e-12 for g, v in zip(got[1:], values[1:]))
    assert abs(stats.unit_root_critical(0.05) - -2.8615928) < 1e-6
    assert abs(stats.unit_root_p(stats.unit_root_critical(0.01)) - 0.01) < 1e-9


def test_raw_walk_is_not_stationary_and_differenced_is(spark):
    assert stats.unit_root_p(fd.unit_root_stat(logs(500).log_close.to_numpy())) > 0.05
    x = fd.differenced(logs(2000).log_close.to_numpy(), np.array(fd.ffd_weights(0.3)))
    x = x[~np.isnan(x)]
    assert len(x) > 50 and stats.unit_root_p(fd.unit_root_stat(x)) < 0.05


def test_search_finds_the_smallest_order(spark):
    df = frame(spark, pd.concat([logs(1000), logs(60, "B", 2)]), SERIES)
    table = fd.unit_root_table(df, p_values=True)
    got = result(table, "ticker", "d")
    assert got[got.ticker == "A"].d.tolist() == fd.D_GRID
    passing = got[(got.ticker == "A") & (got.p_value < 0.05)]
    best = {r.ticker: r.d for r in fd.optimal_d(table).collect()}
    assert best["A"] == (passing.d.min() if len(passing) else 1.0)
    assert best["B"] == 1.0 and (got[got.ticker == "B"].p_value == 1.0).all()


def test_panel(spark):
    bars = frame(spark, bars_pdf(["A", "SPY"], 400), BAR_DDL)
    panel = fd.fracdiff_panel(bars, ["SPY"], thresh=1e-3)
    got = result(panel, "ticker", "date")
    spy, a = got[got.ticker == "SPY"], got[got.ticker == "A"]
    assert (spy.fracdiff_d == 0).all() and (spy.fracdiff_close == spy.log_close).all()
    best = fd.optimal_d(fd.unit_root_table(fd.log_price(bars), thresh=1e-3)).filter("ticker = 'A'").first().d
    assert set(a.fracdiff_d) == {best}
    close_to(a.fracdiff_close, fd.differenced(a.log_close.to_numpy(), np.array(fd.ffd_weights(best, 1e-3))))
    summary = fd.d_summary(fd.d_per_ticker(panel), ["SPY"]).first()
    assert summary.n_tickers == 1 and summary.mean_d == best


def test_log_price_floor(spark):
    rows = [("A", days(3)[0], 0.0), ("A", days(3)[1], None), ("A", days(3)[2], 1.0)]
    got = result(fd.log_price(frame(spark, rows, "ticker string, date date, close double")), "date").log_close
    close_to(got, [np.log(1e-8), np.nan, 0.0])


def test_a_pass_over_many_tickers_gives_the_same_orders(spark):
    from panelspark.functions.ewm import per_run

    pdf = pd.concat([bars_pdf([t], n, seed=n) for t, n in (("A", 700), ("B", 1), ("MKT", 90), ("C", 60))], ignore_index=True)
    pdf.loc[::97, "close"] = np.nan
    bars = frame(spark, pdf, BAR_DDL)
    want = result(fd.fracdiff_panel(bars, ["MKT"]), "ticker", "date")
    names, inputs, compute = fd.fracdiff_beside(["MKT"])
    got = result(per_run(fd.benchmark_logs(bars, ["MKT"]), names, inputs, compute), "ticker", "date")
    for c in ("log_close", "fracdiff_d", "fracdiff_close"):
        close_to(got[c], want[c], 0)
