"""Writers: bars, panels, curves, the universe document and the results summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path, mode="overwrite") -> None:
    """Bars by year, each file sorted by ticker and date, so scans skip by date and ticker statistics.

    Rows are spread by range of (year, ticker, date): file sizes follow the data, and neither a busy
    year nor a large ticker ends in one task.
    """
    (
        bars.withColumn("year", F.year("date"))
        .repartitionByRange("year", "ticker", "date").sortWithinPartitions("year", "ticker", "date")
        .write.mode(mode).partitionBy("year").parquet(path)
    )


def write_panel(panel: DataFrame, path, mode="overwrite") -> None:
    panel.write.mode(mode).parquet(path)


def write_csv(table: DataFrame, path, mode="overwrite") -> None:
    """A report table (daily returns, importances) as CSV with a header."""
    table.write.mode(mode).option("header", True).csv(path)


def write_json(document: DataFrame, path, mode="overwrite") -> None:
    document.write.mode(mode).json(path)


def results_summary(ic_summary: DataFrame, metrics: DataFrame, optimal_d: DataFrame, config: dict) -> DataFrame:
    """One nested row: IC summary, performance metrics, d per ticker and the run's settings.

    The first two inputs are one-row tables. The map of d holds one entry per ticker, as the document
    asks for; for a universe too large for one document write ``optimal_d`` as a table instead.
    """
    d_map = optimal_d.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "d")))).alias("optimal_fracdiff_d"))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    return (
        ic_summary.select(F.struct(*ic_summary.columns).alias("ic_summary"))
        .crossJoin(F.broadcast(metrics.select(F.struct(*metrics.columns).alias("performance_metrics"))))
        .crossJoin(F.broadcast(d_map))
        .withColumn("config", settings)
    )
