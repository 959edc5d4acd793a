import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import BAR_DDL, bars_pdf, day, frame, plan, result
from pyspark.sql import functions as F

from panelspark.operators import fracdiff
from panelspark.schema import BAR
from panelspark.sources import bars as sb
from panelspark.sources import sinks
from panelspark.sources import universe as un


def test_build_bars_against_pandas(spark):
    rng = np.random.RandomState(3)
    n = 600
    pdf = pd.DataFrame({"t": rng.choice(["A", "B"], n, p=[0.95, 0.05]), "d": [day("2024-01-01") + dt.timedelta(int(x)) for x in rng.randint(0, 9, n)],
                        "p": rng.rand(n), "v": rng.randint(1, 9, n).astype(float), "i": rng.permutation(n)})
    got = result(sb.build_bars(frame(spark, pdf, "t string, d date, p double, v double, i long"),
                               "t", "d", "p", "v", ["i"], composite="ALL"), "ticker", "date")
    both = pd.concat([pdf, pdf.assign(t="ALL")]).sort_values("i").groupby(["t", "d"])
    want = both.agg(open=("p", "first"), high=("p", "max"), low=("p", "min"), close=("p", "last"), volume=("v", "sum")).reset_index()
    assert len(got) == len(want) and (got.ticker == want.t).all()
    for c in ("open", "high", "low", "close", "volume"):
        np.testing.assert_allclose(got[c], want[c])


def test_null_prices_keep_the_bar(spark):
    df = frame(spark, [("A", day("2024-01-01"), None, 5.0, 1)], "t string, d date, p double, v double, i long")
    row = sb.build_bars(df, "t", "d", "p", "v", ["i"]).first()
    assert row.open is None and row.close is None and row.volume == 5.0


def test_dedupe_keeps_the_first(spark):
    df = frame(spark, [("A", day("2024-01-01"), 3.0, 2), ("A", day("2024-01-01"), 1.0, 1), ("A", day("2024-01-02"), 9.0, 3)],
               "ticker string, date date, close double, i long")
    got = result(sb.dedupe_first(df, ["i"]), "date")
    assert got.close.tolist() == [1.0, 9.0] and list(got.columns) == ["ticker", "date", "close", "i"]


def test_normalise_vendor_columns(spark):
    rows = [("A", dt.datetime(2024, 1, 2, 16, 0), 1.0, 2.0, 0.5, 1.5, 100, "x"),
            ("A", dt.datetime(2024, 1, 2, 9, 30), 7.0, 8.0, 6.0, 7.5, 50, "x"),
            ("A", dt.datetime(2024, 1, 3, 0, 0), 2.0, 3.0, 1.0, 2.5, 10, "x")]
    raw = spark.createDataFrame(rows, "Ticker string, Datetime timestamp, Open double, High double, Low double, Close double, Volume long, Extra string")
    got = result(sb.normalise_bars(raw), "date")
    assert list(got.columns) == [f.name for f in BAR.fields]
    assert got.date.tolist() == [day("2024-01-02"), day("2024-01-03")]
    assert got.close.tolist() == [7.5, 2.5]  # the earlier time stamp of the first day wins


def test_normalise_time_zone(spark):
    raw = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 2, 0), 1.0)], "ticker string, date timestamp, close double")
    assert sb.normalise_bars(raw, "America/New_York").first().date == day("2024-01-01")


def test_missing_price_columns_are_null(spark):
    raw = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0)], "Ticker string, Date date, Close double")
    row = sb.normalise_bars(raw).first()
    assert row.open is None and row.close == 1.0


def test_round_trip_and_pushdown(spark, tmp_path):
    df = frame(spark, bars_pdf(["A", "B"], 300), BAR_DDL)
    path = str(tmp_path / "bars")
    sinks.write_bars(df, path)
    back = sb.read_bars(spark, path, "2024-02-01", "2024-03-29", ["A"])
    want = df.filter("ticker = 'A' and date between '2024-02-01' and '2024-03-29'")
    assert sorted(back.collect()) == sorted(want.collect())
    text = plan(back)
    assert "PartitionFilters: [isnotnull(year" in text and "GreaterThanOrEqual(date" in text
    assert "EqualTo(ticker,A)" in text


def test_read_one_file_per_ticker(spark, tmp_path):
    pdf = bars_pdf(["AA", "BB"], 5)
    for t, part in pdf.groupby("ticker"):
        part.drop(columns="ticker").rename(columns=str.capitalize).to_parquet(tmp_path / f"{t}.parquet")
    (tmp_path / "CC.parquet").write_bytes(b"not parquet")
    got = result(sb.read_ticker_files(spark, str(tmp_path), skip_corrupt=True), "ticker", "date")
    assert got.ticker.unique().tolist() == ["AA", "BB"] and len(got) == 10


def test_timestamp_range_filter_is_pushed(spark, data):
    li = sb.date_range(spark.read.parquet(f"{data}/lineitem.parquet"), "1996-01-01", "1996-12-31", "l_shipdate")
    assert "GreaterThanOrEqual(l_shipdate" in plan(li) and "LessThan(l_shipdate" in plan(li)
    assert li.agg(F.max("l_shipdate")).first()[0] <= dt.datetime(1996, 12, 31)


SECTORS = {"Tech": ["B", "A"], "Energy": ["C"], "Banks": ["D", "E"]}


def test_universe(spark, tmp_path):
    dim = un.from_sector_lists(spark, SECTORS)
    got = result(dim, "ticker")
    assert got.sector_code.tolist() == [2, 2, 1, 0, 0]
    assert [r.ticker for r in un.all_tickers(dim).collect()] == list("ABCDE")
    assert [tuple(r) for r in un.sector_counts(dim).collect()] == [("Banks", 2), ("Tech", 2), ("Energy", 1)]
    document = un.universe_document(dim, ["SPY"], "2012-01-01", "2024-12-31", "test")
    row = document.first()
    assert row.n_tickers == 5 and row.tickers == list("ABCDE") and row.sector_map["C"] == "Energy"
    assert row.sectors["Tech"] == ["A", "B"] and row.benchmarks == ["SPY"]
    sinks.write_json(document, str(tmp_path / "universe"))
    assert result(un.read_universe(spark, str(tmp_path / "universe")), "ticker").equals(got)


def test_results_summary_document(spark, tmp_path):
    ic = spark.createDataFrame([(0.1, 5)], "mean_ic double, n_periods long")
    metrics = spark.createDataFrame([(1.5,)], "sharpe_ratio double")
    d = spark.createDataFrame([("A", 0.2), ("B", 0.3)], "ticker string, d double")
    sinks.write_json(sinks.results_summary(ic, metrics, d, {"cost_bps": 8.0, "train_end": "2022-12-31"}), str(tmp_path / "s"))
    row = spark.read.json(str(tmp_path / "s")).first()
    assert row.ic_summary.n_periods == 5 and row.performance_metrics.sharpe_ratio == 1.5
    assert row.optimal_fracdiff_d.B == 0.3 and row.config.cost_bps == 8.0


def test_csv_sink(spark, tmp_path):
    table = spark.createDataFrame([(day("2024-01-01"), 0.5)], "date date, net_return double")
    sinks.write_csv(table, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().net_return == "0.5"


def test_panel_sink(spark, tmp_path):
    panel = frame(spark, bars_pdf(["A"], 10), BAR_DDL)
    sinks.write_panel(fracdiff.log_price(panel), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10


def test_corrupt_files_fail_or_are_skipped_on_request(spark, tmp_path):
    from panelspark.sources import bars as sb

    for t in ("A", "B"):
        frame(spark, bars_pdf([t], 5), BAR_DDL).drop("ticker").toPandas().to_parquet(tmp_path / f"{t}.parquet")
    (tmp_path / "C.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    with pytest.raises(Exception):
        sb.read_ticker_files(spark, str(tmp_path)).count()
    got = sb.read_ticker_files(spark, str(tmp_path), skip_corrupt=True)
    assert got.select("ticker").distinct().count() == 2
    asked = spark.createDataFrame([(t,) for t in "ABCDA"], "ticker string")
    assert sorted(r.ticker for r in sb.missing_tickers(asked, got).collect()) == ["C", "D"]


def test_packed_orders_sort_as_tuples(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 1, 9, 99998]), rng.choice([None, 0, 7, 10**15]), rng.randrange(3)) for i in range(300)]
    df = frame(spark, rows, "i long, a long, b long, c int").select("i", sb.packed_order(["a", "b", "c"], (5, 18, 1)).alias("k"))
    got = {r.i: r.k for r in df.collect()}
    key = lambda r: tuple(-1 if v is None else v for v in r[1:])
    for x, y in zip(rows, rows[1:]):
        assert (got[x[0]] < got[y[0]]) == (key(x) < key(y)) and (got[x[0]] == got[y[0]]) == (key(x) == key(y))


@pytest.mark.parametrize("value", [-1, 99, 10**18])
def test_values_beyond_their_digits_fail(spark, value):
    with pytest.raises(Exception, match="order value beyond 2 digits"):
        frame(spark, [(value,)], "a long").select(sb.packed_order(["a"], (2,))).collect()


def test_packed_bars_equal_sorted_ones(spark):
    import random

    rng = random.Random(4)
    rows = [(f"T{rng.randrange(3)}", day("2024-01-01"), rng.choice([None, rng.random()]), 1.0, i // 3, i % 3) for i in range(200)]
    df = frame(spark, rows, "t string, d date, p double, v double, i long, j long")
    bars = [result(sb.build_bars(df, "t", "d", "p", "v", ["i", "j"], "ALL", digits=n), "ticker") for n in (None, (19, 19))]
    assert bars[0].equals(bars[1])
