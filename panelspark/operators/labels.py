"""Returns, rolling market regression, residuals, forward targets and triple-barrier labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.rolling import change, div, forward, long_sums, series
from panelspark.operators.quality import coverage
from panelspark.schema import BETA_WINDOW, LABEL_HORIZON


def daily_return(bars: DataFrame) -> DataFrame:
    return bars.withColumn("daily_return", change("close"))


def market_returns(bars: DataFrame, market: str) -> DataFrame:
    """(date, market_return) of one ticker: a row per calendar day, small enough to broadcast."""
    one = bars.filter(F.col("ticker") == market).select("ticker", "date", "close")
    return one.select("date", change("close").alias("market_return"))


def market_model(df: DataFrame, window: int = BETA_WINDOW, r="daily_return", m="market_return") -> DataFrame:
    """Add rolling_beta and rolling_alpha: the trailing regression of ``r`` on ``m``, today included.

    beta = sample covariance / sample variance, alpha = mean(r) - beta * mean(m), both null until the
    last ``window`` rows are all complete pairs; beta is null where the market did not move (a variance
    below the rounding error of its own sums).
    """
    pair = F.col(r).isNotNull() & F.col(m).isNotNull()
    rr, mm = F.when(pair, F.col(r)), F.when(pair, F.col(m))
    sums = long_sums(df, window, {
        "__n": F.when(pair, 1.0), "__r": rr, "__m": mm, "__rm": rr * mm, "__mm": mm * mm})
    n = F.lit(float(window))
    cov = F.col("__rm") - F.col("__r") * F.col("__m") / n
    var = F.col("__mm") - F.col("__m") * F.col("__m") / n
    moved = var > F.lit(1e-13) * F.col("__mm")
    sums = sums.withColumn("rolling_beta", F.when((F.col("__n") == n) & moved, div(cov, var)))
    alpha = F.col("__r") / n - F.col("rolling_beta") * F.col("__m") / n
    return sums.withColumn("rolling_alpha", alpha).select(*df.columns, "rolling_beta", "rolling_alpha")


def residual_returns(bars: DataFrame, market: str, window: int = BETA_WINDOW) -> DataFrame:
    """Add daily_return, market_return, rolling_beta, rolling_alpha and residual_return.

    The market is regressed on itself by definition: beta 1 and alpha 0 on all its rows.
    """
    own = F.col("ticker") == market
    df = daily_return(bars).join(F.broadcast(market_returns(bars, market)), "date", "left")
    df = market_model(df.select(*bars.columns, "daily_return", "market_return"), window)
    df = df.withColumns({
        "rolling_beta": F.when(own, F.lit(1.0)).otherwise(F.col("rolling_beta")),
        "rolling_alpha": F.when(own, F.lit(0.0)).otherwise(F.col("rolling_alpha")),
    })
    fitted = F.col("rolling_alpha") + F.col("rolling_beta") * F.col("market_return")
    return df.withColumn("residual_return", F.col("daily_return") - fitted)


def forward_residual(df: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """The target: the sum of the next ``horizon`` residual returns."""
    return df.withColumn("fwd_residual_return", forward(F.sum, "residual_return", horizon))


def forward_raw(df: DataFrame, horizon: int = LABEL_HORIZON) -> DataFrame:
    """The plain sum (not the compound) of the next ``horizon`` daily returns."""
    return df.withColumn("fwd_raw_return", forward(F.sum, "daily_return", horizon))


def label_panel(bars: DataFrame, market: str, window: int = BETA_WINDOW, horizon: int = LABEL_HORIZON) -> DataFrame:
    return forward_raw(forward_residual(residual_returns(bars, market, window), horizon), horizon)


def label_coverage(labelled: DataFrame) -> DataFrame:
    return coverage(labelled, "fwd_residual_return")


def triple_barrier(df: DataFrame, price="close", vol="vol", pt_mult=2.0, sl_mult=2.0, max_hold=5) -> DataFrame:
    """Add barrier_label (1, -1, 0) and barrier_date for an entry on every row.

    The barriers are ``price * (1 +- mult * vol)``. The first of the next ``max_hold`` rows at or beyond
    one of them decides, the upper one first; without a touch the sign of the last move decides.
    A missing or non-positive vol and a ticker's last row give label 0 without a date.
    """
    w = series()
    upper = F.col(price) * (1 + F.lit(float(pt_mult)) * F.col(vol))
    lower = F.col(price) * (1 - F.lit(float(sl_mult)) * F.col(vol))
    ahead = [F.lead(F.struct(F.col("date").alias("d"), F.col(price).alias("p")), k).over(w)
             for k in range(1, max_hold + 1)]
    marked = df.withColumns({f"__f{k}": c for k, c in enumerate(ahead)})
    marked = marked.withColumns({"__up": upper, "__lo": lower})
    label, when = F.lit(None).cast("int"), F.lit(None).cast("date")
    for k in reversed(range(max_hold)):
        p, d = F.col(f"__f{k}.p"), F.col(f"__f{k}.d")
        touch = F.when(p >= F.col("__up"), 1).when(p <= F.col("__lo"), -1)
        label = F.coalesce(touch, label)
        when = F.when(touch.isNotNull(), d).otherwise(when)
    last = F.coalesce(*[F.col(f"__f{k}") for k in reversed(range(max_hold))])
    open_end = F.signum(last["p"] - F.col(price)).cast("int")
    live = (F.col(vol) > 0) & F.col("__f0").isNotNull()
    marked = marked.withColumns({
        "barrier_label": F.when(live, F.coalesce(label, open_end, F.lit(0))).otherwise(0),
        "barrier_date": F.when(live, F.coalesce(when, last["d"])),
    })
    return marked.select(*df.columns, "barrier_label", "barrier_date")
