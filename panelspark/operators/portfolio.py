"""Quantile legs, inverse-volatility weights and positions held between rebalance dates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crossrank import SPLIT_ROWS, all_present, group_rank
from panelspark.functions.rolling import div
from panelspark.schema import N_QUANTILES, REBALANCE_FREQ
from panelspark.storage import materialize


def quantile_legs(scores: DataFrame, n_quantiles=N_QUANTILES, score="score", split_rows=SPLIT_ROWS) -> DataFrame:
    """Add leg: 1 for the top quantile of a date's scores, -1 for the bottom one, else 0.

    Equal scores are ordered by ticker. A date with fewer names than quantiles is all 0. Scores must
    not be null.
    """
    sizes = scores.groupBy("date").agg(F.count(F.lit(1)).alias("__n"))
    ranked = group_rank(scores, "date", score, "__rank", method="first", tiebreak="ticker", split_rows=split_rows)
    # one size per day: small at any number of names
    ranked = ranked.join(F.broadcast(sizes), "date")
    low = F.col("__n") / F.lit(float(n_quantiles))
    high = F.col("__n") * (n_quantiles - 1) / F.lit(float(n_quantiles))
    leg = F.when(F.col("__n") < n_quantiles, 0).when(F.col("__rank") > high, 1).when(F.col("__rank") <= low, -1)
    return ranked.withColumn("leg", F.coalesce(leg, F.lit(0)).cast("int")).select(*scores.columns, "leg")


def inverse_vol_weights(legs: DataFrame, vol="vol") -> DataFrame:
    """Add weight: 1/vol scaled to sum to +1 over a date's long leg and -1 over its short leg.

    Names without a positive volatility get 0. ``legs`` is read twice: the leg totals (three rows per
    day at most) are aggregated and broadcast back, so no task ever holds a whole date.
    """
    with_inverse = legs.withColumn("__iv", F.when(F.col("leg") != 0, div(F.lit(1.0), vol)))
    totals = with_inverse.groupBy("date", "leg").agg(F.sum("__iv").alias("__total"))
    weight = F.coalesce(div(F.col("leg") * F.col("__iv"), "__total"), F.lit(0.0))
    return with_inverse.join(F.broadcast(totals), ["date", "leg"]).withColumn("weight", weight) \
        .select(*legs.columns, "weight")


def rebalance_schedule(panel: DataFrame, score="predicted_score", vol="realized_vol_20", freqs=(REBALANCE_FREQ,),
                       n_quantiles=N_QUANTILES) -> DataFrame:
    """Per frequency and date: whether it rebalances, whether that works, and the date whose weights are held.

    Every ``freq``-th date of the panel, from the first, is due. It fails with fewer than two names per
    quantile; then nothing is held on that day and the earlier weights return on the next. The windows
    run on the date table (a row per day), never on the panel.
    """
    valid = F.count_if(all_present([score, vol]))
    dates = panel.groupBy("date").agg(valid.alias("n_valid"))
    dates = dates.withColumn("rebalance_freq", F.explode(F.array(*[F.lit(int(f)) for f in freqs])))
    w = Window.partitionBy("rebalance_freq").orderBy("date")
    dates = dates.withColumn("is_due", (F.row_number().over(w) - 1) % F.col("rebalance_freq") == 0) \
        .withColumn("is_rebalance", F.col("is_due") & (F.col("n_valid") >= 2 * n_quantiles))
    held = F.last(F.when(F.col("is_rebalance"), F.col("date")), ignorenulls=True)
    return dates.withColumn("rebalance_date", held.over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("rebalance_date", F.when(~F.col("is_due") | F.col("is_rebalance"), F.col("rebalance_date")))


def rebalance_weights(panel: DataFrame, schedule: DataFrame, score="predicted_score", vol="realized_vol_20",
                      n_quantiles=N_QUANTILES, split_rows=SPLIT_ROWS) -> DataFrame:
    """(rebalance_date, ticker, weight) for each date on which some frequency rebalances."""
    days = schedule.filter("is_rebalance").select("date").distinct()
    rows = panel.filter(all_present([score, vol])).join(F.broadcast(days), "date", "left_semi") \
        .select("date", "ticker", F.col(score).alias("score"), F.col(vol).alias("vol"))
    # the ranked legs feed both the leg totals and the weights, so they are written once
    legs = materialize(quantile_legs(rows, n_quantiles, split_rows=split_rows).filter(F.col("leg") != 0))
    return inverse_vol_weights(legs).filter(F.col("weight") != 0) \
        .select(F.col("date").alias("rebalance_date"), "ticker", "weight")


def construct_portfolio(panel: DataFrame, score="predicted_score", vol="realized_vol_20", freqs=(REBALANCE_FREQ,),
                        n_quantiles=N_QUANTILES, return_lag: int = 0, split_rows=SPLIT_ROWS) -> DataFrame:
    """(rebalance_freq, date, ticker, weight, leg, daily_return, rebalance_date), a row per held name and day.

    ``panel`` has date, ticker, daily_return and the two named columns; it is read several times, so pass
    a stored one. A held name without a panel row on a day is not recorded that day. Weights earn
    the return of their own day; ``return_lag=1`` makes them earn the next row's return instead.
    Weights depend on the date alone, so several frequencies share one ranking.
    """
    schedule = rebalance_schedule(panel, score, vol, freqs, n_quantiles)
    weights = rebalance_weights(panel, schedule, score, vol, n_quantiles, split_rows)
    held = schedule.filter(F.col("rebalance_date").isNotNull()).select("rebalance_freq", "date", "rebalance_date")
    rows = panel.select("date", "ticker", "daily_return")
    if return_lag:
        ahead = F.lead("daily_return", return_lag).over(Window.partitionBy("ticker").orderBy("date"))
        rows = rows.withColumn("daily_return", ahead)
    # the schedule has one row per day and frequency; names meet weights on a balanced two-column key
    return rows.join(F.broadcast(held), "date").join(weights, ["rebalance_date", "ticker"]) \
        .withColumn("leg", F.when(F.col("weight") > 0, "long").otherwise("short")) \
        .select("rebalance_freq", "date", "ticker", "weight", "leg", "daily_return", "rebalance_date")


def portfolio_summary(positions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Due rebalance dates and recorded long and short rows, per frequency."""
    due = schedule.groupBy("rebalance_freq").agg(F.count_if("is_due").alias("n_rebalances"))
    legs = positions.groupBy("rebalance_freq").agg(
        F.count_if(F.col("leg") == "long").alias("n_long"), F.count_if(F.col("leg") == "short").alias("n_short"))
    return due.join(legs, "rebalance_freq", "left").select(
        "rebalance_freq", "n_rebalances", F.coalesce("n_long", F.lit(0)).alias("n_long"),
        F.coalesce("n_short", F.lit(0)).alias("n_short"))


def weight_check(positions: DataFrame, keys=()) -> DataFrame:
    """Per date: leg sums, gross and net exposure and names per leg."""
    is_long, is_short = F.col("weight") > 0, F.col("weight") < 0
    sums = positions.groupBy(*keys, "date").agg(
        F.coalesce(F.sum(F.when(is_long, F.col("weight"))), F.lit(0.0)).alias("long_weight_sum"),
        F.coalesce(F.sum(F.when(is_short, F.col("weight"))), F.lit(0.0)).alias("short_weight_sum"),
        F.count_if(is_long).alias("n_long"), F.count_if(is_short).alias("n_short"))
    return sums.withColumns({
        "gross_exposure": F.col("long_weight_sum") - F.col("short_weight_sum"),
        "net_exposure": F.col("long_weight_sum") + F.col("short_weight_sum"),
    })


def exposure_summary(check: DataFrame) -> DataFrame:
    return check.agg(F.avg(F.abs("net_exposure")).alias("mean_abs_net"), F.avg("gross_exposure").alias("mean_gross"))
