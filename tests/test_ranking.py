import math
import numpy as np
import pandas as pd
import pytest
from conftest import close_to, days, frame, result

from panelspark.functions.stats import correlation_p_column
from panelspark.operators import ranking as rk

SCHEMA = "date date, ticker string, predicted_score double, fwd_raw_return double"


def p_value(spark, r, n):
    return frame(spark, [(float(r), int(n))], "r double, n long").select(correlation_p_column("r", "n")).first()[0]


def cross_sections():
    rng = np.random.RandomState(4)
    rows = []
    for i, d in enumerate(days(12)):
        n = 9 if i == 0 else 25
        x, y = np.round(rng.randn(n), 1), np.round(rng.randn(n), 1)
        if i == 1:
            y = x.copy()
        if i == 2:
            y = -x
        if i == 3:
            x[:] = 5.0
        for k in range(n):
            rows.append((d, f"T{k:02d}", None if (i, k) == (4, 3) else x[k], y[k]))
    return pd.DataFrame(rows, columns=["date", "ticker", "predicted_score", "fwd_raw_return"])


@pytest.mark.parametrize("split_rows", [1 << 20, 6])
def test_ic_against_pandas(spark, split_rows):
    pdf = cross_sections()
    got = result(rk.rank_ic(frame(spark, pdf, SCHEMA), split_rows=split_rows), "date")
    want = []
    for d, g in pdf.dropna().groupby("date"):
        if len(g) >= 10:
            want.append((d, g.predicted_score.rank().corr(g.fwd_raw_return.rank()), len(g)))
    assert got.date.tolist() == [w[0] for w in want] and got.n_stocks.tolist() == [w[2] for w in want]
    close_to(got.ic, [w[1] for w in want])
    close_to(got.ic[:2], [1, -1])
    assert np.isnan(got.ic[2])


def test_summary_and_running_sum(spark):
    rows = [(d, x) for d, x in zip(days(5), [.1, -.2, .3, None, .05])]
    ic = frame(spark, rows, "date date, ic double")
    s = pd.Series([.1, -.2, .3, .05])
    row = rk.ic_summary(ic).first()
    close_to([row.mean_ic, row.ic_std, row.ir, row.ic_tstat, row.n_periods, row.pct_positive],
             [s.mean(), s.std(), s.mean() / s.std(), s.mean() / s.std() * 5 ** .5, 5, 60])
    close_to(result(rk.cumulative_ic(ic), "date").cum_ic, [.1, -.1, .2, .2, .25])
    empty = rk.ic_summary(ic.filter("false")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0, 0)


def test_date_choice(spark):
    pdf = cross_sections()
    chosen = frame(spark, [(days(12)[5],), (days(12)[7],)], "date date")
    assert rk.rank_ic(frame(spark, pdf, SCHEMA), dates=chosen).count() == 2


def test_p_values(spark):
    # two-sided Student t tail by numerical integration
    from math import gamma, pi, sqrt
    for r, n in ((.5, 20), (-.3, 12), (.05, 100), (.95, 10)):
        df = n - 2
        t = abs(r) * sqrt(df / (1 - r * r))
        grid = np.linspace(0, t, 200001)
        density = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2)) * (1 + grid ** 2 / df) ** (-(df + 1) / 2)
        area = ((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0])
        assert abs(p_value(spark, r, n) - (1 - 2 * area)) < 1e-8
    assert p_value(spark, 1.0, 20) == 0 and abs(p_value(spark, 0.0, 20) - 1) < 1e-12
    assert abs(p_value(spark, 1.96e-4, 100_000_000) - math.erfc(1.96 / math.sqrt(2))) < 1e-7 and p_value(spark, 0.9, 100_000) < 1e-9
    assert abs(p_value(spark, 0.5, 3) - (1 - 2 * math.asin(0.5) / math.pi)) < 1e-11 and p_value(spark, 0.5, 2) is None
    got = result(rk.rank_ic(frame(spark, cross_sections(), SCHEMA), p_values=True), "date")
    assert got.p_value[0] == 0 and np.isnan(got.p_value[2]) and got.p_value.dropna().between(0, 1).all()
