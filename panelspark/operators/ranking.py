"""Cross-sectional rank correlation of scores with what followed."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crossrank import SPLIT_ROWS, all_present, group_ranks
from panelspark.functions.rolling import div
from panelspark.functions.stats import correlation_p_column
from panelspark.schema import MIN_STOCKS


def rank_ic(panel: DataFrame, predicted="predicted_score", realized="fwd_raw_return", min_stocks=MIN_STOCKS,
            p_values=False, dates: DataFrame = None, split_rows=SPLIT_ROWS) -> DataFrame:
    """(date, ic, n_stocks[, p_value]): Spearman correlation with average ranks for ties, per date.

    Dates with fewer than ``min_stocks`` complete pairs are left out; ``ic`` is null where one side is
    constant. ``dates`` (a one-column table, one row per day) restricts the days, for example to
    rebalance dates.
    """
    pairs = panel.filter(all_present([predicted, realized])).select("date", "ticker", predicted, realized)
    if dates is not None:
        pairs = pairs.join(F.broadcast(dates.select("date").distinct()), "date", "left_semi")
    ranked = group_ranks(pairs, "date", {"__rx": predicted, "__ry": realized}, method="average",
                         tiebreak="ticker", split_rows=split_rows)
    ic = div(F.covar_samp("__rx", "__ry"), F.stddev_samp("__rx") * F.stddev_samp("__ry"))
    out = ranked.groupBy("date").agg(ic.alias("ic"), F.count(F.lit(1)).alias("n_stocks")) \
        .filter(F.col("n_stocks") >= min_stocks)
    return out.withColumn("p_value", correlation_p_column("ic", "n_stocks")) if p_values else out


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: mean, deviation, information ratio, t-statistic, periods and share of positive dates."""
    mean, dev = F.avg("ic"), F.stddev_samp("ic")
    ir = F.coalesce(F.when(dev > 0, div(mean, dev)), F.lit(0.0))
    return ic.agg(
        F.coalesce(mean, F.lit(0.0)).alias("mean_ic"), F.coalesce(dev, F.lit(0.0)).alias("ic_std"),
        ir.alias("ir"), (ir * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("ic_tstat"),
        F.count(F.lit(1)).alias("n_periods"),
        F.coalesce(F.avg(F.when(F.col("ic") > 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("pct_positive"),
    )


def cumulative_ic(ic: DataFrame) -> DataFrame:
    """Running sum of the daily correlation. The table has a row per day, so one ordered window is fine."""
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ic.select("date", "ic", F.sum("ic").over(past).alias("cum_ic"))
