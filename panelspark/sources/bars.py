"""Bar sources: reading stored bars, normalising vendor columns and building bars from raw rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.schema import BAR, PRICE_COLUMNS


def read_bars(spark: SparkSession, path, start=None, end=None, tickers=None, skip_corrupt=False) -> DataFrame:
    """Stored bars with a fixed schema; the date and ticker filters reach the Parquet scan.

    ``start`` and ``end`` are inclusive dates or 'YYYY-MM-DD' strings. An unreadable file fails the
    read, unless ``skip_corrupt``; ``missing_tickers`` then tells which tickers have no bars.
    """
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).schema(BAR).parquet(path)
    if "year" in df.columns:  # the layout of ``sinks.write_bars``: whole years are skipped
        if start is not None:
            df = df.filter(F.col("year") >= int(str(start)[:4]))
        if end is not None:
            df = df.filter(F.col("year") <= int(str(end)[:4]))
    df = date_range(df, start, end)
    df = df.filter(F.col("ticker").isin(list(tickers))) if tickers is not None else df
    return df.select(*BAR.names)


def missing_tickers(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """The requested tickers that have no bar: absent from the store, or in files that were skipped."""
    return requested.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def read_ticker_files(spark: SparkSession, path, pattern=r"([^/]+)\.parquet$", timezone=None, skip_corrupt=False) -> DataFrame:
    """A folder with one Parquet file per ticker: the ticker comes from the file name."""
    raw = (
        spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("recursiveFileLookup", "true").parquet(path)
        .withColumn("ticker", F.regexp_extract(F.input_file_name(), pattern, 1))
    )
    return normalise_bars(raw, timezone)


def normalise_bars(raw: DataFrame, timezone=None) -> DataFrame:
    """Vendor columns to the bar schema: any letter case, Datetime for Date, midnight dates, one row per date.

    Values stamped with an instant are read as wall-clock time of ``timezone`` (default: the session's).
    Missing price columns stay null, other columns are dropped.
    """
    lower = {c.lower(): c for c in raw.columns}
    if "date" not in lower and "datetime" in lower:
        lower["date"] = lower["datetime"]
    when = F.col(f"`{lower['date']}`")
    if timezone:
        when = F.from_utc_timestamp(F.to_utc_timestamp(when, F.current_timezone()), timezone)
    columns = [F.col(f"`{lower['ticker']}`").cast("string").alias("ticker"), F.to_date(when).alias("date")]
    for c in PRICE_COLUMNS:
        present = F.col(f"`{lower[c]}`").cast("double") if c in lower else F.lit(None).cast("double")
        columns.append(present.alias(c))
    columns.append(when.cast("timestamp").alias("__at"))
    return dedupe_first(raw.select(*columns), ["__at", *PRICE_COLUMNS]).drop("__at")


def packed_order(order, digits) -> Column:
    """An order of several whole-number columns as one decimal of at most 38 digits, which sorts as their tuple does.

    ``digits`` bounds each column. A null comes first. A negative value, or one with more digits, fails the query: no
    row is ever put in a wrong place. One fixed-width value lets aggregates that pick by order keep it in a hash table's
    buffer, where a tuple would make them sort the rows.
    """
    if sum(digits) > 38 or len(digits) != len(order):
        raise ValueError("one number of digits per column, 38 in all")
    packed, left = None, sum(digits)
    for column, n in zip(order, digits):
        left -= n
        c = _c(column).cast("decimal(20,0)")
        place = F.when(c.isNull(), 0).when((c >= 0) & (c < F.lit("9" * n).cast("decimal(38,0)")), c + 1).otherwise(
            F.raise_error(F.concat(F.lit(f"order value beyond {n} digits: "), c.cast("string"))).cast("decimal(20,0)"))
        term = (place.cast(f"decimal({n},0)") * F.lit("1" + "0" * left).cast(f"decimal({left + 1},0)")).cast("decimal(38,0)")
        packed = term if packed is None else (packed + term).cast("decimal(38,0)")
    return packed


def dedupe_first(bars: DataFrame, order=None, keys=("ticker", "date"), digits=None) -> DataFrame:
    """One row per key: the first in ``order`` (default: all remaining columns, so the choice is stable).

    An aggregate, not a window: duplicates collapse before the shuffle, so a key that holds a large
    share of the rows costs one row per task. With ``digits`` (see ``packed_order``; the order must then be unique
    inside a key) numbers and dates are picked in a hash aggregate, without a sort.
    """
    rest = [c for c in bars.columns if c not in keys]
    order = list(order) if order else [F.col(c) for c in rest]
    if digits:
        placed = bars.withColumn("__place", packed_order(order, digits))
        picked = placed.groupBy(*keys).agg(*[F.min_by(c, "__place").alias(c) for c in rest])
        return picked.select(*bars.columns)
    first = F.min_by(F.struct(*rest), F.struct(*[_c(o).alias(f"k{i}") for i, o in enumerate(order)]))
    picked = bars.groupBy(*keys).agg(first.alias("__row"))
    return picked.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in bars.columns])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_range(df: DataFrame, start=None, end=None, column="date") -> DataFrame:
    """Rows between two inclusive days. Filter the source's own column, so that Parquet can skip data."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(str(start)).cast(df.schema[column].dataType))
    if end is not None:
        kind = df.schema[column].dataType.typeName()
        if kind.startswith("timestamp"):
            day_after = F.date_add(F.lit(str(end)).cast("date"), 1).cast(df.schema[column].dataType)
            df = df.filter(F.col(column) < day_after)
        else:
            df = df.filter(F.col(column) <= F.lit(str(end)).cast(df.schema[column].dataType))
    return df


def build_bars(rows: DataFrame, ticker, day, price, volume, order, composite=None, key=None, digits=None) -> DataFrame:
    """Open/high/low/close/volume bars from raw rows, one per ticker and day.

    ``order`` lists columns whose tuple is unique inside a bar and tells first from last; ``digits`` bounds their
    values, so that first and last prices are picked by hash aggregates (see ``packed_order``; without it rows are sorted). A
    null price counts for nothing but keeps the bar. ``composite`` names an extra ticker built from all rows (a
    market): it is aggregated from the finished bars' parts, not from a second scan. ``key`` names the raw
    column behind ``ticker`` when there is one: grouping by a number and naming the ticker afterwards is
    cheaper than grouping by a text. Rows are combined before they are exchanged, so a key or day that
    holds a large share of them sends one row per task.
    """
    place = packed_order(order, digits) if digits else F.struct(*[_c(c).alias(f"k{i}") for i, c in enumerate(order)])
    group = key or "ticker"
    raw = rows.select(_c(key if key else ticker).alias(group), _c(day).alias("date"), _c(price).alias("p"), _c(volume).alias("volume"), place.alias("k"))
    raw = raw.withColumn("k", F.when(F.col("p").isNotNull(), F.col("k")))
    parts = raw.groupBy(group, "date").agg(
        F.min("k").alias("first"), F.max("k").alias("last"), F.min_by("p", "k").alias("open"), F.max_by("p", "k").alias("close"),
        F.max("p").alias("high"), F.min("p").alias("low"), F.sum("volume").alias("volume"))
    if key:
        parts = parts.withColumn("ticker", _c(ticker)).drop(key)
    if composite is not None:
        parts = (
            parts.withColumn("ticker", F.explode(F.array(F.col("ticker"), F.lit(composite))))
            .groupBy("ticker", "date")
            .agg(F.min_by("open", "first").alias("open"), F.max_by("close", "last").alias("close"),
                 F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
        )
    return parts.select("ticker", "date", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))
