"""The plans that matter at scale: exchanges, sorts, broadcasts and what the scan reads."""

import os
import re
import time

import pytest
from conftest import BAR_DDL, bars_pdf, frame, plan
from pyspark.sql import functions as F

from panelspark import storage
from panelspark.functions.crossrank import group_rank
from panelspark.operators import backtest, features, fracdiff, labels, portfolio
from panelspark.plans import catalog, inputs
from panelspark.sources import universe as un
from panelspark.storage import materialize, work_dir


@pytest.fixture(scope="module")
def bars(spark):
    return materialize(frame(spark, bars_pdf(["A", "B", "MKT"], 30), BAR_DDL))


def test_features_cost_one_exchange_and_two_sorts(spark, bars):
    universe = materialize(un.from_sector_lists(spark, {"X": ["A"]}))
    text = plan(features.engineer_features(labels.daily_return(bars), universe))
    assert text.count("Exchange hashpartitioning(ticker") == 1 and text.count("Sort [") == 2
    assert "BroadcastHashJoin" in text and "Python" not in text


def test_labels_broadcast_the_market_and_exchange_once(bars):
    text = plan(labels.label_panel(bars, "MKT", 10, 5))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(ticker", text)) == 2  # the panel and the market's own rows


def test_fracdiff_is_one_exchange(bars):
    text = plan(fracdiff.fracdiff_panel(bars, ["MKT"]))
    assert text.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInArrow" in text
    assert plan(fracdiff.unit_root_table(fracdiff.log_price(bars))).count("Exchange hashpartitioning") == 1


def test_no_window_spans_a_whole_date(bars):
    ranked = group_rank(bars.select("date", "ticker", "close"), "date", "close", "r", tiebreak="ticker")
    windows = re.findall(r"Window \[row_number.*?\], \[(.*?)\], \[", plan(ranked))
    assert windows and all("__piece" in w for w in windows)
    assert "CartesianProduct" not in plan(ranked)


def test_portfolio_plans_have_no_cross_join(bars):
    panel = materialize(bars.select("date", "ticker", F.col("close").alias("predicted_score"),
                                    F.col("volume").alias("realized_vol_20"), F.lit(0.1).alias("daily_return")))
    positions = portfolio.construct_portfolio(panel, n_quantiles=1)
    daily = backtest.portfolio_returns(positions)
    for df in (positions, daily):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_bars_read_what_they_need(spark, data):
    text = plan(inputs.daily_bars(spark, data, "1996-01-01", "1996-12-31"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_returnflag" not in schema and "l_extendedprice" not in schema
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    # raw rows are combined before they are exchanged
    assert re.search(r"partial_max", text)


def test_results_are_stored_in_the_shared_folder(spark, bars):
    stored = materialize(bars)
    assert stored.inputFiles() and all(work_dir(spark).removeprefix("file:") in f for f in stored.inputFiles())
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or work_dir(spark) == configured.rstrip("/")
    assert stored.schema == bars.schema and materialize(bars).inputFiles() != stored.inputFiles()


def test_one_scan_for_labels_and_no_nested_loops_over_the_panel(spark, data):
    from panelspark.plans.catalog import QUERIES

    for name in ("rolling_beta", "forward_targets", "label_coverage"):
        assert "lineitem" not in plan(QUERIES[name](spark, data))  # bars are stored, then read twice
    for name in ("purged_folds_date", "fold_leakage"):
        assert "NestedLoop" not in plan(QUERIES[name](spark, data))


def test_bars_are_built_without_a_sort(spark, data):
    from panelspark.plans.catalog import QUERIES

    for name in ("bars_daily", "bars_weekly", "bars_users", "dedupe_first"):
        text = plan(QUERIES[name](spark, data))
        assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_ranks_take_few_exchanges(spark, data):
    from panelspark.plans.catalog import QUERIES

    for name in ("rank_ic", "quantile_legs"):
        text = plan(QUERIES[name](spark, data))
        assert text.count("Exchange") <= 4 and text.count("FileScan") <= 4


def test_stored_bars_come_in_parts_of_bounded_rows(spark, bars):
    dealt = inputs.by_ticker(bars, task_rows=5)
    assert dealt.rdd.getNumPartitions() == -(-bars.count() // 5) == 18
    assert plan(labels.daily_return(dealt)).count("Exchange") == 1  # a window by ticker needs no other
    assert sorted(dealt.collect()) == sorted(bars.collect())


def test_the_score_panel_builds_no_market(spark, data, monkeypatch):
    plans = []
    monkeypatch.setattr(inputs, "materialize", lambda df: plans.append(plan(df)) or df)
    inputs.score_panel(spark, data)
    assert plans and "explode" not in plans[0].lower()


@pytest.mark.parametrize("name", ["scores_linear", "scores_object"])
def test_scores_build_their_panel_once(spark, data, monkeypatch, name):
    made, real = [], inputs.score_panel
    monkeypatch.setattr(inputs, "score_panel", lambda *a: made.append(1) or real(*a))
    catalog.QUERIES[name](spark, data)
    assert len(made) == 1


def test_bars_of_a_few_tickers_are_those_of_all(spark, data):
    named, every = inputs.bars_of(spark, data, ["S1", "MKT"]), inputs.daily_bars(spark, data).where("ticker in ('S1', 'MKT')")
    assert sorted(named.collect()) == sorted(every.collect())
    assert "explode" not in plan(named).lower()


def shuffle_data(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in held.split("\n") if "/shuffle_" in f and f.endswith(".data")}


def shuffle_bytes(spark, before):
    """Of files that are not among ``before``; some may vanish meanwhile."""
    return sum(os.path.getsize(f) for f in shuffle_data(spark) - before if os.path.exists(f))


@pytest.mark.parametrize("slice_rows", [None, 2000])
def test_stored_bars_are_those_of_all_slices_and_leave_no_shuffle_files(spark, data, slice_rows):
    before = shuffle_data(spark)
    got = inputs.all_bars(spark, data, slice_rows)
    waited = time.monotonic() + 20  # files are removed in the background
    while (left := shuffle_bytes(spark, before)) > 1000 and time.monotonic() < waited:
        time.sleep(0.2)
    assert left < 1000  # but the count of rows
    assert sorted(got.collect()) == sorted(inputs.daily_bars(spark, data).collect())


def test_the_market_is_built_without_another_exchange_of_all_bars(spark, data):
    assert "explode" not in plan(inputs.daily_bars(spark, data)).lower()


@pytest.mark.parametrize("panel", [inputs.feature_panel, inputs.model_panel])
@pytest.mark.parametrize("partitions", ["2", "4", "24"])
def test_panels_exchange_narrow_rows_once(spark, data, panel, partitions):
    """Whatever the universe's size and the session's partitions, the bars are dealt once and nothing wide is joined or exchanged."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide, narrow = plan(panel(spark, data)).split("MapInArrow", 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Exchange" not in wide and "Join" not in wide and "InArrow" not in narrow and "lineitem" not in narrow
    # the bars', the universe's, and with labels the market's own of both
    assert narrow.count("Exchange hashpartitioning(ticker") == (2 if panel is inputs.feature_panel else 4)


@pytest.mark.parametrize("name, tables", [("model_scores", 2), ("cv_search", 1), ("feature_importance", 1)])
def test_models_store_no_wide_panel(spark, data, monkeypatch, name, tables):
    """Training rows are stored with what a model reads, and for scores the features of complete rows."""
    made, real = [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: made.append(real(df)) or made[-1])
    catalog.QUERIES[name](spark, data)
    wide = [t for t in made if len(t.columns) > 7]
    assert len(wide) == tables and wide[-1].where(F.col("date") > F.lit(catalog.TRAIN_END).cast("date")).count() == 0
    features = wide[-1].columns[3:]
    for t in wide:
        assert {"open", "sma_50", "log_close"}.isdisjoint(t.columns)
        missing = F.array(*[F.col(c).isNull() for c in features])
        assert t.where(F.array_contains(missing, True) & F.array_contains(missing, False)).isEmpty()
