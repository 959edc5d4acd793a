"""Cost and frequency scenarios, the ticker screener and the regression report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.rolling import div
from panelspark.operators.backtest import performance_metrics, portfolio_returns, with_costs
from panelspark.schema import COST_BPS, REBALANCE_FREQ, TRADING_DAYS


def cost_sweep(daily: DataFrame, bps=tuple(range(0, 31)), keys=(), days: int = TRADING_DAYS) -> DataFrame:
    """Net metrics for each cost in basis points; only the daily table is repeated."""
    scenario = daily.select(*keys, "date", "gross_return", "turnover",
                            F.explode(F.array(*[F.lit(float(b)) for b in bps])).alias("cost_bps"))
    curves = with_costs(scenario, F.col("cost_bps"), [*keys, "cost_bps"])
    return performance_metrics(curves, "net_return", [*keys, "cost_bps"], days)


def rebalance_sweep(positions: DataFrame, cost_bps=COST_BPS, days: int = TRADING_DAYS) -> DataFrame:
    """Net metrics per rebalance frequency of positions built for several frequencies."""
    daily = portfolio_returns(positions, cost_bps, ["rebalance_freq"])
    return performance_metrics(daily, "net_return", ["rebalance_freq"], days)


def breakeven_cost(daily: DataFrame, keys=()) -> DataFrame:
    """The cost in basis points at which the summed gross return is used up."""
    sums = daily.groupBy(*keys).agg(F.sum("gross_return").alias("sum_gross"), F.sum("turnover").alias("sum_turnover"))
    return sums.withColumn("breakeven_bps", div(F.lit(10000.0) * F.col("sum_gross"), "sum_turnover"))


def screener(panel: DataFrame, positions: DataFrame = None, columns=("rolling_beta", "parkinson_vol_20", "fracdiff_d"),
             sector=None, rebalance_freq: int = REBALANCE_FREQ) -> DataFrame:
    """Each ticker's latest values and latest weight (0 when it is not held on its latest date).

    Positions of several rebalance frequencies count with that of ``rebalance_freq`` only.
    """
    rows = panel.filter(F.col("sector") == sector) if sector is not None else panel
    extra = ["sector"] if "sector" in panel.columns else []
    latest = rows.groupBy("ticker").agg(
        F.max("date").alias("date"), F.max_by(F.struct(*extra, *columns), "date").alias("__row"))
    latest = latest.select("ticker", "date", *[F.col(f"__row.{c}").alias(c) for c in [*extra, *columns]])
    if positions is None:
        return latest
    if "rebalance_freq" in positions.columns:
        positions = positions.filter(F.col("rebalance_freq") == rebalance_freq)
    return latest.join(positions.select("ticker", "date", "weight"), ["ticker", "date"], "left") \
        .withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def regression_report(scored: DataFrame, predicted="predicted_score", actual="fwd_raw_return") -> DataFrame:
    """Samples, errors and R2 per ticker and overall (ticker 'Overall'), next to predicting zero.

    One rollup over moments: R2 = 1 - SSE / SST with SST from the variance of the actual values.
    """
    p, y = F.col(predicted), F.col(actual)
    pairs = scored.filter(p.isNotNull() & y.isNotNull())
    sums = pairs.rollup("ticker").agg(
        F.grouping("ticker").alias("__all"), F.count(F.lit(1)).alias("n"), F.sum((p - y) * (p - y)).alias("sse"),
        F.sum(F.abs(p - y)).alias("sae"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"),
        F.sum(y * y).alias("base_sse"), F.sum(F.abs(y)).alias("base_sae"))
    return sums.select(
        F.when(F.col("__all") == 1, "Overall").otherwise(F.col("ticker")).alias("ticker"),
        F.col("n").alias("n_samples"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"),
        F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"),
        F.sqrt(F.col("base_sse") / F.col("n")).alias("baseline_rmse"),
        (F.col("base_sae") / F.col("n")).alias("baseline_mae"))
