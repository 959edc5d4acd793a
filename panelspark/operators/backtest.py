"""Turnover-costed returns, performance metrics, benchmarks and the tables of a tearsheet.

Per-date tables have one row per day (and scenario), so ordered windows over them are small. Everything
that touches positions is partitioned by ticker or aggregated by date with map-side partial sums.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.rolling import div, mean, std
from panelspark.schema import COST_BPS, TRADING_DAYS


def _by(keys, order="date"):
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def turnover_parts(positions: DataFrame, keys=()) -> DataFrame:
    """(keys, date, turnover, gross) contributions of every position to its own and the following date.

    A position is compared with the same ticker's row on the previous portfolio date; a name that is not
    held on the next portfolio date costs its full weight there. One shuffle by ticker; the daily sums
    are then combined before they are exchanged.
    """
    keys = list(keys)
    days = positions.select(*keys, "date").distinct()
    days = days.withColumns({"__prev": F.lag("date").over(_by(keys)), "__next": F.lead("date").over(_by(keys))})
    w = Window.partitionBy(*keys, "ticker").orderBy("date")
    rows = positions.join(F.broadcast(days), [*keys, "date"]).withColumns({
        "__before": F.lag(F.struct("date", "weight")).over(w), "__after": F.lead("date").over(w)})
    kept = F.when(F.col("__before.date") == F.col("__prev"), F.col("__before.weight")).otherwise(0.0)
    gone = F.col("__next").isNotNull() & ~F.coalesce(F.col("__after") == F.col("__next"), F.lit(False))
    parts = F.array(
        F.struct(F.col("date").alias("date"), F.abs(F.col("weight") - kept).alias("turnover"),
                 (F.col("weight") * F.col("daily_return")).alias("gross")),
        F.struct(F.col("__next").alias("date"), F.abs("weight").alias("turnover"),
                 F.lit(None).cast("double").alias("gross")),
    )
    return rows.select(*keys, F.inline(F.filter(parts, lambda p: (p["date"] == F.col("date")) | gone)))


def portfolio_returns(positions: DataFrame, cost_bps: float = COST_BPS, keys=()) -> DataFrame:
    """(keys, date, gross_return, turnover, cost, net_return, cum_gross, cum_net) per portfolio date."""
    daily = turnover_parts(positions, keys).groupBy(*keys, "date").agg(
        F.coalesce(F.sum("gross"), F.lit(0.0)).alias("gross_return"), F.sum("turnover").alias("turnover"))
    return with_costs(daily, F.lit(float(cost_bps)), keys)


def with_costs(daily: DataFrame, bps, keys=()) -> DataFrame:
    """Cost, net return and both compounded curves of a table with gross_return and turnover."""
    past = _by(list(keys)).rowsBetween(Window.unboundedPreceding, 0)
    costed = daily.withColumn("cost", F.col("turnover") * bps / F.lit(10000.0)) \
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return costed.withColumns({
        "cum_gross": F.product(1 + F.col("gross_return")).over(past),
        "cum_net": F.product(1 + F.col("net_return")).over(past),
    }).select(*keys, "date", "gross_return", "turnover", "cost", "net_return", "cum_gross", "cum_net")


def drawdown(curve: DataFrame, cum="cum_net", keys=(), name="drawdown") -> DataFrame:
    """Fall from the highest value so far; the first value is the first peak."""
    peak = F.max(cum).over(_by(list(keys)).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn(name, div(cum, peak) - 1)


def performance_metrics(daily: DataFrame, return_col="net_return", keys=(), days: int = TRADING_DAYS) -> DataFrame:
    """One row of metrics per key; nothing for fewer than two returns.

    Sortino divides by the deviation of the negative returns (of all returns when none is negative, and
    0 when there is just one). turnover and cost count where the table has them.
    """
    keys, r = list(keys), F.col(return_col)
    past = _by(keys).rowsBetween(Window.unboundedPreceding, 0)
    has = set(daily.columns)
    curve = daily.filter(r.isNotNull()).withColumn("__cum", F.product(1 + r).over(past))
    curve = curve.withColumn("__fall", div("__cum", F.max("__cum").over(past)) - 1)
    m = curve.groupBy(*keys).agg(
        F.count(r).alias("n"), F.product(1 + r).alias("growth"), F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("dev"), F.stddev_samp(F.when(r < 0, r)).alias("down"),
        F.count_if(r < 0).alias("n_down"), F.min("__fall").alias("fall"), F.count_if(r > 0).alias("n_up"))
    costs = daily.groupBy(*keys).agg(
        (F.sum("turnover") if "turnover" in has else F.lit(0.0)).alias("turnover"),
        (F.sum("cost") if "cost" in has else F.lit(0.0)).alias("cost"))
    m = m.filter(F.col("n") >= 2)
    m = m.join(F.broadcast(costs), keys) if keys else m.crossJoin(F.broadcast(costs))
    root = F.lit(math.sqrt(days))
    down = F.when(F.col("n_down") > 0, F.col("down")).otherwise(F.col("dev"))
    years = F.col("n") / F.lit(float(days))
    m = m.withColumn("annualized", F.when(F.col("growth") >= 0, F.pow("growth", 1 / years) - 1))
    return m.select(
        *keys,
        (F.col("growth") - 1).alias("total_return"),
        F.col("annualized").alias("annualized_return"),
        (F.col("dev") * root).alias("annualized_volatility"),
        F.coalesce(F.when(F.col("dev") > 0, F.col("mean") / F.col("dev") * root), F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce(F.when(down > 0, F.col("mean") / down * root), F.lit(0.0)).alias("sortino_ratio"),
        F.col("fall").alias("max_drawdown"),
        F.when(F.col("fall") == 0, F.lit(0.0)).otherwise(div("annualized", F.abs("fall"))).alias("calmar_ratio"),
        (F.coalesce("turnover", F.lit(0.0)) / years).alias("annualized_turnover"),
        (F.col("n_up") / F.col("n") * F.lit(100.0)).alias("win_rate_pct"),
        F.col("n").alias("n_trading_days"),
        (F.coalesce("cost", F.lit(0.0)) * F.lit(10000.0)).alias("total_cost_bps"),
    )


def gross_and_net_metrics(daily: DataFrame, keys=(), days: int = TRADING_DAYS) -> DataFrame:
    """``performance_metrics`` of both return columns, told apart by ``series``."""
    both = daily.select(*keys, "date", "turnover", "cost", F.inline(F.array(
        F.struct(F.lit("gross").alias("series"), F.col("gross_return").alias("ret")),
        F.struct(F.lit("net").alias("series"), F.col("net_return").alias("ret")))))
    return performance_metrics(both, "ret", [*keys, "series"], days)


def benchmark_returns(panel: DataFrame, tickers, start=None, end=None) -> DataFrame:
    """(ticker, date, daily_return, cum_return): buy and hold, compounded from the start of the range."""
    rows = panel.filter(F.col("ticker").isin(list(tickers)))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    past = _by(["ticker"]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.filter(F.col("daily_return").isNotNull()).select(
        "ticker", "date", "daily_return", F.product(1 + F.col("daily_return")).over(past).alias("cum_return"))


def benchmark_metrics(benchmarks: DataFrame, days: int = TRADING_DAYS) -> DataFrame:
    return performance_metrics(benchmarks, "daily_return", ["ticker"], days)


def within_portfolio_dates(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Panel rows between the first and last portfolio date, without an action on the driver."""
    span = daily.agg(F.min("date").alias("__first"), F.max("date").alias("__last"))
    return panel.join(F.broadcast(span), (F.col("date") >= F.col("__first")) & (F.col("date") <= F.col("__last"))) \
        .select(*panel.columns)


def rolling_sharpe(daily: DataFrame, window: int = 63, ret="net_return", days: int = TRADING_DAYS, keys=()) -> DataFrame:
    w = _by(list(keys))
    value = div(mean(ret, window, w), std(ret, window, w)) * F.lit(math.sqrt(days))
    return daily.select(*keys, "date", value.alias("rolling_sharpe"))


def tearsheet_equity(daily: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(date, curve, value): the strategy's gross and net curves and each benchmark on the strategy's dates."""
    own = daily.select("date", F.inline(F.array(
        F.struct(F.lit("gross").alias("curve"), F.col("cum_gross").alias("value")),
        F.struct(F.lit("net").alias("curve"), F.col("cum_net").alias("value")))))
    days = daily.select("date")
    other = benchmarks.join(F.broadcast(days), "date", "left_semi") \
        .select("date", F.col("ticker").alias("curve"), F.col("cum_return").alias("value"))
    return own.unionByName(other)


def tearsheet_drawdown(daily: DataFrame) -> DataFrame:
    return drawdown(daily).select("date", (F.col("drawdown") * 100).alias("drawdown_pct"))


def tearsheet_ic(ic: DataFrame) -> DataFrame:
    """The correlation series with its mean on every row."""
    average = ic.agg(F.avg("ic").alias("mean_ic"))
    return ic.crossJoin(F.broadcast(average)).select("date", "ic", "mean_ic")
