from conftest import BAR_DDL, bars_pdf, day, frame, result

from panelspark.operators import quality as ql


def bar(date, close=1.0, ticker="A", volume=1.0):
    return (ticker, day(date), close, close, close, close, volume)


def test_gaps(spark):
    dates = ["2024-01-01", "2024-01-02", "2024-01-06", "2024-01-11", "2024-01-17", "2024-01-24", "2024-02-03"]
    got = result(ql.gap_report(frame(spark, [bar(d) for d in dates], BAR_DDL)), "gap_start")
    assert got.calendar_days.tolist() == [5, 6, 7, 10]
    assert got.approx_trading_days.tolist() == [2, 3, 4, 6]
    assert got.action.tolist() == ["forward_filled", "forward_filled", "flagged_data_quality_issue", "flagged_data_quality_issue"]


def test_fill_and_drop(spark):
    rows = [bar("2024-01-01", None), bar("2024-01-02", 2.0), bar("2024-01-03", None), bar("2024-01-04", None, volume=None),
            bar("2024-01-01", None, "B")]
    got = result(ql.clean(frame(spark, rows, BAR_DDL)), "date")
    assert got.close.tolist() == [2.0, 2.0, 2.0] and got.volume.tolist() == [1.0, 1.0, 1.0]
    assert set(got.ticker) == {"A"}


def test_history(spark):
    import pandas as pd
    pdf = pd.concat([bars_pdf(["A"], 500), bars_pdf(["B"], 499), bars_pdf(["C"], 99)])
    df = frame(spark, pdf, BAR_DDL)
    assert [r.ticker for r in ql.min_history(df).select("ticker").distinct().collect()] == ["A"]
    assert {r.ticker: r.n_rows for r in ql.dropped_tickers(df).collect()} == {"B": 499, "C": 99}
    report = result(ql.history_report(df), "ticker")
    assert report.few_rows.tolist() == [False, False, True] and report.dropped.tolist() == [False, True, True]
