import numpy as np
import pandas as pd
import pytest
from conftest import close_to, days, frame, result

from panelspark.operators import portfolio as pf

D = days(1)[0]
PANEL = "date date, ticker string, predicted_score double, realized_vol_20 double, daily_return double"


def legs_of(spark, scores, **options):
    df = frame(spark, [(D, f"T{i:03d}", float(s)) for i, s in enumerate(scores)], "date date, ticker string, score double")
    return result(pf.quantile_legs(df, **options), "ticker")


@pytest.mark.parametrize("split_rows", [1 << 20, 7])
def test_leg_counts(spark, split_rows):
    got = legs_of(spark, range(100), split_rows=split_rows)
    assert (got.leg == 1).sum() == 20 and (got.leg == -1).sum() == 20 and (got.leg == 0).sum() == 60
    assert got[got.leg == 1].score.min() == 80 and got[got.leg == -1].score.max() == 19


def test_uneven_and_small_groups(spark):
    got = legs_of(spark, range(98))
    assert (got.leg == -1).sum() == 19 and (got.leg == 1).sum() == 20
    assert (legs_of(spark, range(3)).leg == 0).all()
    ten = legs_of(spark, range(10, 101, 10))
    assert ten.leg.tolist() == [-1, -1, 0, 0, 0, 0, 0, 0, 1, 1]
    tied = legs_of(spark, [1.0] * 5)
    assert tied.leg.tolist() == [-1, 0, 0, 0, 1]


def weights_of(spark, vols, legs):
    rows = [(D, f"T{i}", v, leg) for i, (v, leg) in enumerate(zip(vols, legs))]
    return result(pf.inverse_vol_weights(frame(spark, rows, "date date, ticker string, vol double, leg int")), "ticker").weight


def test_weights(spark):
    close_to(weights_of(spark, [.02, .03, .04, .01, .05], [1, 1, 0, -1, -1]), [.6, .4, 0, -5 / 6, -1 / 6])
    low, high = weights_of(spark, [.01, .05], [1, 1])
    assert low > high
    close_to(weights_of(spark, [.03] * 3, [1] * 3), [1 / 3] * 3)
    close_to(weights_of(spark, [0.0, None, .02], [1, 1, 1]), [0, 0, 1])


def test_leg_sums_of_many_names(spark):
    rng = np.random.RandomState(42)
    rows = [(D, f"T{i}", float(s), float(v)) for i, (v, s) in enumerate(zip(rng.uniform(.01, .05, 100), rng.randn(100)))]
    legs = pf.quantile_legs(frame(spark, rows, "date date, ticker string, score double, vol double"))
    got = result(pf.inverse_vol_weights(legs))
    long_sum, short_sum = got.weight[got.weight > 0].sum(), got.weight[got.weight < 0].sum()
    close_to([long_sum, short_sum], [1, -1])


def panel_pdf(seed=11, n_days=23, n_names=12):
    rng = np.random.RandomState(seed)
    rows = []
    for i, d in enumerate(days(n_days)):
        for k in range(n_names):
            if (i, k) in {(6, 3), (7, 3), (12, 11)}:
                continue  # a name that misses days
            score = round(float(rng.randn()), 1)  # ties
            if i == 10 and k >= 5:
                score = None  # a rebalance date that fails
            vol = 0.0 if (i, k) == (5, 2) else float(rng.uniform(.01, .05))
            rows.append((d, f"T{k:02d}", score, vol, None if (i, k) == (8, 4) else float(rng.randn() * .01)))
    return pd.DataFrame(rows, columns=["date", "ticker", "predicted_score", "realized_vol_20", "daily_return"])


def by_day(pdf, freq, q):
    """Positions day by day, from the definition."""
    held, since, out = {}, None, []
    for i, d in enumerate(sorted(pdf.date.unique())):
        today = pdf[pdf.date == d]
        if i % freq == 0:
            valid = today.dropna(subset=["predicted_score", "realized_vol_20"]).sort_values(["predicted_score", "ticker"])
            n = len(valid)
            if n < 2 * q:
                continue
            rank = np.arange(1, n + 1)
            leg = np.where(rank > n * (q - 1) / q, 1, np.where(rank <= n / q, -1, 0))
            held = {}
            for s in (1, -1):
                part = valid[(leg == s) & (valid.realized_vol_20 > 0).to_numpy()]
                inverse = 1 / part.realized_vol_20
                held |= dict(zip(part.ticker, s * inverse / inverse.sum()))
            since = d
        for t, w in held.items():
            row = today[today.ticker == t]
            if len(row) and w != 0:
                out.append((d, t, w, "long" if w > 0 else "short", row.daily_return.iloc[0], since))
    return pd.DataFrame(out, columns=["date", "ticker", "weight", "leg", "daily_return", "rebalance_date"]) \
        .sort_values(["date", "ticker"], ignore_index=True)


def test_positions_match_a_day_by_day_loop(spark):
    pdf = panel_pdf()
    got = result(pf.construct_portfolio(frame(spark, pdf, PANEL), freqs=(5, 3), n_quantiles=4), "rebalance_freq", "date", "ticker")
    for freq in (5, 3):
        mine, want = got[got.rebalance_freq == freq].reset_index(drop=True), by_day(pdf, freq, 4)
        assert mine.ticker.tolist() == want.ticker.tolist() and mine.date.tolist() == want.date.tolist()
        assert mine.leg.tolist() == want.leg.tolist() and mine.rebalance_date.tolist() == want.rebalance_date.tolist()
        close_to(mine.weight, want.weight)
        close_to(mine.daily_return, want.daily_return)
    assert days(23)[10] not in set(got[got.rebalance_freq == 5].date)  # the failed date holds nothing


def test_next_day_option(spark):
    pdf = panel_pdf()
    got = result(pf.construct_portfolio(frame(spark, pdf, PANEL), n_quantiles=4, return_lag=1), "date", "ticker")
    following = pdf.sort_values(["ticker", "date"]).assign(nxt=lambda x: x.groupby("ticker").daily_return.shift(-1))
    want = got.merge(following, on=["date", "ticker"]).nxt
    close_to(got.daily_return, want)


def test_summaries(spark):
    pdf = panel_pdf()
    df = frame(spark, pdf, PANEL)
    positions = pf.construct_portfolio(df, n_quantiles=4)
    check = result(pf.weight_check(positions), "date")
    whole = check[check.n_long + check.n_short == check.n_long.max() + check.n_short.max()]
    close_to(whole.gross_exposure, [2.0] * len(whole))
    close_to(whole.net_exposure, [0.0] * len(whole))
    row = pf.portfolio_summary(positions, pf.rebalance_schedule(df, n_quantiles=4)).first()
    want = by_day(pdf, 5, 4)
    assert (row.n_rebalances, row.n_long, row.n_short) == (5, (want.leg == "long").sum(), (want.leg == "short").sum())
    exposure = pf.exposure_summary(pf.weight_check(positions)).first()
    close_to([exposure.mean_gross], [check.gross_exposure.mean()])
