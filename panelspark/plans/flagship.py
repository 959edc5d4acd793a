"""One question end to end: what does a long/short portfolio of part brands earn after costs?"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.rolling import change
from panelspark.operators import backtest, features, labels, portfolio
from panelspark.plans.inputs import MARKET, weekly_bars
from panelspark.storage import materialize


def weekly_long_short(spark: SparkSession, sf_dir: str, n_quantiles: int = 2) -> DataFrame:
    bars = labels.daily_return(weekly_bars(spark, sf_dir))
    panel = materialize(bars.select(
        "ticker", "date", "daily_return", change("close", 5).alias("predicted_score"),
        features.realized_vol(20).alias("realized_vol_20")).filter(F.col("ticker") != MARKET))
    positions = materialize(portfolio.construct_portfolio(panel, n_quantiles=n_quantiles))
    return backtest.portfolio_returns(positions)
