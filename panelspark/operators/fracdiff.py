"""Fractional differencing with a fixed window, and the search for the smallest stationary order.

Filters are up to a thousand rows long, too long for a window expression, so they run on Arrow batches of
one ticker. A ticker has one row per day: a century is 36,525 rows, whatever the size of the panel.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.rolling import div, series
from panelspark.functions.stats import unit_root_critical, unit_root_p_column
from panelspark.schema import ADF_P, D_GRID, FFD_MAX_SIZE, FFD_THRESH, MIN_ADF_ROWS


def ffd_weights(d: float, thresh: float = FFD_THRESH, max_size: int = FFD_MAX_SIZE) -> list:
    """Binomial weights of (1 - B) ** d, newest first, cut at the first one below ``thresh``."""
    weights = [1.0]
    while len(weights) < max_size:
        k = len(weights)
        following = -weights[-1] * (d - k + 1) / k
        if abs(following) < thresh:
            break
        weights.append(following)
    return weights


def log_price(bars: DataFrame, close="close") -> DataFrame:
    return bars.withColumn("log_close", F.when(F.col(close).isNotNull(), F.log(F.greatest(F.col(close), F.lit(1e-8)))))


def column_name(d: float) -> str:
    return f"ffd_{round(d * 1000):04d}"


def ffd(df: DataFrame, grid, y="log_close", thresh: float = FFD_THRESH, form: str = "convolve") -> DataFrame:
    """Add one differenced column per order in ``grid`` (see ``column_name``).

    The first rows of a ticker, up to the filter length, are null. A ticker shorter than the filter keeps
    the newest weights that fit and yields a value on its last row only.
    form "convolve": one Arrow batch per ticker, all orders together. form "arrays": a frame of values
    folded against the weights in the JVM, a cross-check whose cost per row grows with the filter.
    """
    weights = {d: ffd_weights(d, thresh) for d in grid}
    if form == "convolve":
        return _ffd_convolve(df, weights, y)
    if form != "arrays":
        raise ValueError(f"unknown form {form!r}")
    by_date = series()
    total = by_date.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = df.withColumns({
        "__rows": F.count(F.lit(1)).over(total), "__row": F.row_number().over(by_date),
        **{f"__frame{i}": F.collect_list(y).over(by_date.rowsBetween(-(len(w) - 1), 0))
           for i, w in enumerate(weights.values())},
    })
    out = {}
    for i, (d, w) in enumerate(weights.items()):
        frame = F.col(f"__frame{i}")
        newest = F.slice(F.array(*[F.lit(x) for x in reversed(w)]), -F.size(frame), F.size(frame))
        dot = F.aggregate(F.zip_with(frame, newest, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        at_end = (F.col("__row") == F.col("__rows")) & (F.size(frame) == F.col("__rows"))
        out[column_name(d)] = F.when((F.size(frame) == len(w)) | at_end, dot)
    return sized.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def _ffd_convolve(df: DataFrame, weights: dict, y: str) -> DataFrame:
    schema = T.StructType(list(df.schema.fields) + [T.StructField(column_name(d), T.DoubleType()) for d in weights])
    filters = {column_name(d): np.array(w) for d, w in weights.items()}

    def one_ticker(rows):
        rows = rows.sort_by("date")
        values = _doubles(rows, y)
        for name, w in filters.items():
            rows = rows.append_column(name, _nullable(differenced(values, w)))
        return rows

    return df.groupBy("ticker").applyInArrow(one_ticker, schema)


def _doubles(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).to_pandas().to_numpy(dtype=float)


def _nullable(values) -> pa.Array:
    return pa.array(values, type=pa.float64(), from_pandas=True)


def differenced(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The filter applied to one ordered series, NaN where it does not fit."""
    out = np.full(len(values), np.nan)
    w = weights[:len(values)]
    if len(w):
        out[len(w) - 1:] = np.convolve(values, w, mode="valid")
    return out


# A determinant at rounding level means a constant or perfectly fitted series: no test.
SINGULAR = 1e-14


def unit_root_stat(x: np.ndarray) -> float:
    """The test statistic of one differenced series without its warm-up; NaN where there is no test."""
    x = x[~np.isnan(x)]
    if len(x) < MIN_ADF_ROWS:
        return np.nan
    step = np.diff(x)
    (a, c, p), (_, b, q), (_, _, s) = np.cov(np.vstack([x[1:-1], step[:-1], step[1:]]))
    det, m = a * b - c * c, len(step) - 1
    if not det > SINGULAR * a * b:
        return np.nan
    g, h = (p * b - q * c) / det, (q * a - p * c) / det
    spread = (m - 1) * (s - g * p - h * q) / (m - 3) * b / ((m - 1) * det)
    return g / np.sqrt(spread) if spread > 0 else np.nan


def unit_root(df: DataFrame, columns) -> DataFrame:
    """(ticker, column, n_obs, stat) of the lag-1 test with a constant, for stored columns.

    All in the JVM: two lags per column and one aggregate of second moments per ticker. ``stat`` is null
    (p = 1) where fewer than 50 values exist or the series is constant.
    """
    w = series()
    lags = {}
    for x in columns:
        lags |= {f"__1_{x}": F.lag(x, 1).over(w), f"__2_{x}": F.lag(x, 2).over(w)}
    lagged = df.select("ticker", *columns, *[c.alias(n) for n, c in lags.items()])
    sums = lagged.groupBy("ticker").agg(*[_moments(x).alias(f"__m_{x}") for x in columns])
    rows = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"__m_{x}.n").alias("n_obs"),
                              _statistic(F.col(f"__m_{x}")).alias("stat")) for x in columns])
    return sums.select("ticker", F.inline(rows))


def _moments(x: str):
    """Counts and second moments of the level before (u), the change before (v) and the change (y)."""
    before, two = F.col(f"__1_{x}"), F.col(f"__2_{x}")
    ok = F.col(x).isNotNull() & before.isNotNull() & two.isNotNull()
    u, v, y = F.when(ok, before), F.when(ok, before - two), F.when(ok, F.col(x) - before)
    return F.struct(
        F.count(x).alias("n"), F.count(u).alias("m"), F.var_samp(u).alias("a"), F.var_samp(v).alias("b"),
        F.covar_samp(u, v).alias("c"), F.covar_samp(u, y).alias("p"), F.covar_samp(v, y).alias("q"),
        F.var_samp(y).alias("s"))


def _statistic(moments):
    m, a, b, c, p, q, s = (moments[k] for k in "mabcpqs")
    det = a * b - c * c
    g, h = div(p * b - q * c, det), div(q * a - p * c, det)
    spread = div((m - 1) * (s - g * p - h * q), m - 3) * div(b, (m - 1) * det)
    sound = (moments["n"] >= MIN_ADF_ROWS) & (det > F.lit(SINGULAR) * a * b) & (spread > 0)
    return F.when(sound, div(g, F.sqrt(F.when(sound, spread))))


def unit_root_table(df: DataFrame, grid=None, y="log_close", thresh: float = FFD_THRESH,
                    p_values: bool = False) -> DataFrame:
    """(ticker, d, n_obs, stat) for each order: the unit-root test of the differenced series.

    One exchange by ticker; each ticker tries every order on its own batch and returns one row per
    order, so the panel is never multiplied by the grid.
    """
    filters = {float(d): np.array(ffd_weights(d, thresh)) for d in (D_GRID if grid is None else grid)}

    def one_ticker(rows):
        rows = rows.sort_by("date")
        series_by_d = [differenced(_doubles(rows, y), w) for w in filters.values()]
        return pa.table({
            "ticker": pa.array([rows.column("ticker")[0].as_py()] * len(filters), pa.string()),
            "d": pa.array(list(filters), pa.float64()),
            "n_obs": pa.array([int((~np.isnan(x)).sum()) for x in series_by_d], pa.int64()),
            "stat": _nullable([unit_root_stat(x) for x in series_by_d]),
        })

    table = df.select("ticker", "date", y).groupBy("ticker") \
        .applyInArrow(one_ticker, "ticker string, d double, n_obs long, stat double")
    if p_values:
        table = table.withColumn("p_value", F.coalesce(unit_root_p_column("stat"), F.lit(1.0)))
    return table


def optimal_d(tests: DataFrame, p_threshold: float = ADF_P) -> DataFrame:
    """(ticker, d): the smallest order whose test rejects a unit root, else 1.0."""
    passed = F.when(F.col("stat") < F.lit(unit_root_critical(p_threshold)), F.col("d"))
    return tests.groupBy("ticker").agg(F.coalesce(F.min(passed), F.lit(1.0)).alias("d"))


def order_search(grid=None, p_threshold: float = ADF_P, thresh: float = FFD_THRESH):
    """A function that gives the order and the differenced values of one ordered series: of the smallest order that passes, else of 1."""
    filters = [(float(d), np.array(ffd_weights(d, thresh))) for d in sorted(D_GRID if grid is None else grid)]
    whole, critical = np.array(ffd_weights(1.0, thresh)), unit_root_critical(p_threshold)

    def search(values: np.ndarray):
        tried = ((d, differenced(values, w)) for d, w in filters)
        d, found = next(((d, x) for d, x in tried if unit_root_stat(x) < critical), (1.0, None))
        return d, differenced(values, whole) if found is None else found

    return search


def fracdiff_beside(benchmarks=(), grid=None, p_threshold: float = ADF_P, thresh: float = FFD_THRESH):
    """fracdiff_d and fracdiff_close of ``fracdiff_panel`` as names, inputs and compute of a pass over many tickers (``per_run``).

    Its input columns log_close and is_benchmark come from ``benchmark_logs``.
    """
    search = order_search(grid, p_threshold, thresh)

    def compute(rows, at):
        logs, fixed = rows["log_close"].to_numpy(), rows["is_benchmark"].to_numpy() > 0
        order, out = np.zeros(len(at)), logs.copy()
        ends = np.r_[np.flatnonzero(at == 0), len(at)]
        for a, b in zip(ends[:-1], ends[1:]):
            if not fixed[a]:
                order[a:b], out[a:b] = search(logs[a:b])
        return {"fracdiff_d": order, "fracdiff_close": out}

    return ["fracdiff_d", "fracdiff_close"], ["log_close", "is_benchmark"], compute


def benchmark_logs(bars: DataFrame, benchmarks=()) -> DataFrame:
    """Add log_close and is_benchmark."""
    return log_price(bars).withColumn("is_benchmark", F.coalesce(F.col("ticker").isin(list(benchmarks)), F.lit(False)))


def fracdiff_panel(bars: DataFrame, benchmarks=(), grid=None, p_threshold: float = ADF_P,
                   thresh: float = FFD_THRESH) -> DataFrame:
    """Add log_close, fracdiff_d and fracdiff_close.

    Search and final series share one exchange by ticker: a ticker's batch tries the orders from the
    smallest, stops at the first that passes and returns its series. Benchmarks keep their log price
    (order 0).
    """
    search, fixed = order_search(grid, p_threshold, thresh), frozenset(benchmarks)
    logs = log_price(bars)
    schema = T.StructType(list(logs.schema.fields) + [
        T.StructField("fracdiff_d", T.DoubleType()), T.StructField("fracdiff_close", T.DoubleType())])

    def one_ticker(rows):
        rows = rows.sort_by("date")
        values = _doubles(rows, "log_close")
        d, result = (0.0, values) if rows.column("ticker")[0].as_py() in fixed else search(values)
        return rows.append_column("fracdiff_d", pa.array(np.full(len(values), d))) \
            .append_column("fracdiff_close", _nullable(result))

    return logs.groupBy("ticker").applyInArrow(one_ticker, schema)


def d_per_ticker(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker").agg(F.max("fracdiff_d").alias("d"))


def d_summary(d_table: DataFrame, benchmarks=()) -> DataFrame:
    """Mean, median, smallest and largest order over the tickers that are not benchmarks."""
    own = d_table.filter(~F.col("ticker").isin(list(benchmarks))) if benchmarks else d_table
    return own.agg(F.avg("d").alias("mean_d"), F.median("d").alias("median_d"), F.min("d").alias("min_d"),
                   F.max("d").alias("max_d"), F.count(F.lit(1)).alias("n_tickers"))
