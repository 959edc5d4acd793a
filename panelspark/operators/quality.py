"""Data-quality rules for bars: gaps, filling, incomplete rows and short histories."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crossrank import all_present
from panelspark.functions.rolling import series
from panelspark.schema import MIN_HISTORY, PRICE_COLUMNS

# The gap rules.
GAP_DAYS = 4
MAX_FILL_DAYS = 3
MIN_ROWS = 100


def gap_report(bars: DataFrame) -> DataFrame:
    """Gaps of more than four calendar days between consecutive rows of a ticker."""
    previous = F.lag("date").over(series())
    days = F.datediff("gap_end", "gap_start")
    trading = (F.floor(F.col("calendar_days") * 5 / F.lit(7)) - 1).cast("int")
    return (
        bars.select("ticker", previous.alias("gap_start"), F.col("date").alias("gap_end"))
        .withColumn("calendar_days", days)
        .filter(F.col("calendar_days") > GAP_DAYS)
        .withColumn("approx_trading_days", trading)
        .withColumn("action", F.when(F.col("approx_trading_days") <= MAX_FILL_DAYS, "forward_filled")
                    .otherwise("flagged_data_quality_issue"))
    )


def forward_fill(bars: DataFrame, columns=None) -> DataFrame:
    """Carry each column's last non-null value forward inside a ticker, without limit."""
    past = series().rowsBetween(Window.unboundedPreceding, 0)
    columns = [c for c in (columns or PRICE_COLUMNS) if c in bars.columns]
    return bars.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def drop_incomplete(bars: DataFrame, columns=None) -> DataFrame:
    return bars.filter(all_present([c for c in (columns or PRICE_COLUMNS) if c in bars.columns]))


def clean(bars: DataFrame) -> DataFrame:
    """Fill, then drop rows that are still incomplete (a ticker's leading nulls)."""
    return drop_incomplete(forward_fill(bars))


def history_report(bars: DataFrame, min_rows: int = MIN_ROWS, min_history: int = MIN_HISTORY) -> DataFrame:
    """Rows per ticker with the two quality flags."""
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("few_rows", F.col("n_rows") < min_rows) \
        .withColumn("dropped", F.col("n_rows") < min_history)


def min_history(bars: DataFrame, days: int = MIN_HISTORY) -> DataFrame:
    """Keep tickers with at least ``days`` rows. The count shares the ticker exchange of later windows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return bars.withColumn("__n", n).filter(F.col("__n") >= days).drop("__n")


def dropped_tickers(bars: DataFrame, days: int = MIN_HISTORY) -> DataFrame:
    """Tickers that ``min_history`` leaves out, with their row counts."""
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < days)


def coverage(df: DataFrame, column: str) -> DataFrame:
    """Valid and total rows of one column, and the percentage."""
    return df.agg(F.count(column).alias("valid"), F.count(F.lit(1)).alias("total")) \
        .withColumn("pct", F.try_divide(F.lit(100.0) * F.col("valid"), F.col("total")))
