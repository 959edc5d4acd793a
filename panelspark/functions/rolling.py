"""Per-ticker window helpers.

A panel holds at most one row per ticker and date (the bar builders guarantee it), so a window
partitioned by ticker never holds more rows than the calendar has days, however large the panel.
Frames count observed rows, not calendar days, and an aggregate is null until its frame is full of
non-null values.
"""

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "ticker"
TIME = "date"


def series(key=KEY, time=TIME) -> WindowSpec:
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    return Window.partitionBy(*keys).orderBy(time)


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """Division that gives null on a zero divisor (plain division raises in ANSI mode)."""
    return F.try_divide(as_col(a), as_col(b))


def roll(agg, x, n, w=None) -> Column:
    """``agg`` over the last ``n`` rows, null unless all ``n`` values are present."""
    x = as_col(x)
    frame = (w if w is not None else series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def forward(agg, x, n, w=None) -> Column:
    """``agg`` over the next ``n`` rows, null unless all ``n`` values are present."""
    x = as_col(x)
    frame = (w if w is not None else series()).rowsBetween(1, n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def change(x, k=1, w=None) -> Column:
    """Relative change over ``k`` rows; null where the earlier value is zero or absent."""
    x = as_col(x)
    return div(x, F.lag(x, k).over(w if w is not None else series())) - 1


def mean(x, n, w=None) -> Column:
    return roll(F.avg, x, n, w)


def std(x, n, w=None) -> Column:
    return roll(F.stddev_samp, x, n, w)


def _frames(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values at every place of the rows of ``x``; NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (n - 1, 0)), constant_values=np.nan), n, axis=-1)


def frame_means(x: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """``mean`` inside a task, of rows of ``x`` that hold series one after the other; NaN unless all ``n`` values are present.

    ``at`` is the place of a value in its series. A frame is added from its oldest value on, as windows do, so that ties stay ties.
    """
    total = np.zeros(x.shape)
    for back in range(min(n, x.shape[1]) - 1, -1, -1):
        total[:, back:] += x[:, :x.shape[1] - back]
    return np.where(at < n - 1, np.nan, total / n)


def frame_stds(x: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """``std`` inside a task. Distances from the frame's last value are summed, so a frame of equal values gives exactly 0."""
    apart = _frames(x, n) - x[:, :, None]
    apart -= apart.mean(axis=-1, keepdims=True)
    return np.where(at < n - 1, np.nan, np.sqrt(np.einsum("ijk,ijk->ij", apart, apart) / (n - 1)))


def before(x: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """``lag`` inside a task: the value ``k`` rows earlier in the series."""
    return np.where(at < k, np.nan, np.r_[np.full(min(k, len(x)), np.nan), x[:max(0, len(x) - k)]])


BLOCK = 2048
BLOCK_COLUMNS = ["__block", "__at"]


def in_blocks(df, rows=BLOCK, key=KEY, time=TIME):
    """Number a series' blocks of ``rows`` rows (``__block``) and the places inside them (``__at``).

    Block sums replace frames that would be too long to evaluate row by row. Operators that need blocks
    share them: add the columns once, and every window ordered by block and time reuses one sort.
    """
    if "__block" in df.columns:
        return df
    keys = [key] if isinstance(key, str) else list(key)
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1
    return df.withColumn("__row", row) \
        .withColumns({"__block": F.floor(F.col("__row") / F.lit(rows)), "__at": F.col("__row") % rows}).drop("__row")


def block_windows(key=KEY, time=TIME):
    """(whole series, head of the block up to the row, whole block): all three have the same sort order."""
    keys = [key] if isinstance(key, str) else list(key)
    across = Window.partitionBy(*keys).orderBy("__block", time)
    inside = Window.partitionBy(*keys, "__block").orderBy(time)
    return (across, inside.rowsBetween(Window.unboundedPreceding, 0),
            inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def long_sums(df, n, sums, key=KEY, time=TIME):
    """Add the sum of each column of ``sums`` (name -> column) over the last ``n`` rows, at constant
    cost per row; nulls count as zero and short frames are summed as they are.

    Spark evaluates a sliding frame in O(n) per row, which a long frame cannot afford. Here a frame is the
    head of the row's block less the head ``n`` rows earlier, plus the rest of the block before when the
    frame starts there. Sums restart in every block, so rounding does not build up along a series and an
    extreme value affects the next block at most. Frames longer than BLOCK rows take blocks of their own length.
    """
    keep, aside = df.columns, {}
    if n > BLOCK and "__block" in keep:
        aside = {c: f"{c}_shared" for c in BLOCK_COLUMNS}
        df = df.withColumnsRenamed(aside)
    df = in_blocks(df, max(n, BLOCK), key, time)
    across, head, whole = block_windows(key, time)
    values = {k: F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for k, c in sums.items()}
    df = df.withColumns({
        **{f"__h_{k}": F.sum(c).over(head) for k, c in values.items()},
        **{f"__t_{k}": F.sum(c).over(whole) for k, c in values.items()},
    })
    earlier = F.lag(F.struct("__block", *[f"__h_{k}" for k in sums], *[f"__t_{k}" for k in sums]), n).over(across)
    df = df.withColumn("__earlier", earlier)
    before = F.col("__earlier.__block")
    out = {}
    for k in sums:
        old, total = F.col(f"__earlier.__h_{k}"), F.col(f"__earlier.__t_{k}")
        here = F.col(f"__h_{k}")
        out[k] = F.when(before.isNull(), here).when(before == F.col("__block"), here - old).otherwise(here + (total - old))
    return df.select(*[F.col(aside.get(c, c)).alias(c) for c in keep], *[c.alias(k) for k, c in out.items()])
