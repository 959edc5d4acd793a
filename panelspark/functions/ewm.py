"""Exponentially weighted means of any span, with nulls anywhere.

With ``g`` rows since the last value the recursion is ``y = ((1 - a)**g * y + a * x) / ((1 - a)**g + a)``, and ``y = x``
at the first value; a null carries the mean on. A weight of 1 gives the last value.

Form "series" runs the recursion over an Arrow batch of one series (a ticker has one row per day: a century is 36,525 rows,
whatever the size of the panel): one exchange and one sort by ticker for all means of a call, and memory for one series.

Form "windows", a cross-check in the JVM, keeps every row of a task several times over, a dozen windows wide. There every value
has a decay and a contribution, and the mean is a sum of contributions, each times the product of the later decays, whose
logarithms add up. A series is cut into blocks of so few rows that a block's decays stay above exp(-500): inside a block
contributions are scaled up, summed and scaled back, and what earlier blocks leave is folded from their ends, a handful per
series. Weights that are too steep for the blocks that other operators share take shorter ones of their own, whose ends are
composed in a tree of groups, so that the work stays linear.
"""

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.rolling import BLOCK, BLOCK_COLUMNS, KEY, TIME, block_windows, in_blocks, series

BLOCK_DECAY = 500.0
#: Log decay of one gap, at most: a value before it would weigh less than any double can tell.
GAP_DECAY = 150.0
#: Blocks in a group, and rows per map at the top of the tree over short blocks, at least.
FAN, TREE_ROWS = 32, 65_536

#: Rows of whole series that ``per_run`` computes at a time, about.
RUN_ROWS = 16_384


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def block_rows(alpha: float) -> int:
    """Rows whose decays stay above exp(-500), a power of two, the shared block length at most; weights below 1."""
    rows = BLOCK_DECAY / -math.log1p(-alpha)
    return int(min(BLOCK, 2 ** math.floor(math.log2(max(rows, 1)))))


def mean_of(x: pd.Series, alpha: float, min_periods: int = 1, of: np.ndarray = None) -> pd.Series:
    """The mean of one ordered series, or of several one after the other with their ascending numbers ``of``; NaN is missing."""
    rows = x if of is None else x.groupby(of)
    found = rows.ewm(alpha=alpha, adjust=False, ignore_na=False, min_periods=min_periods).mean()
    return found if of is None else pd.Series(found.to_numpy(), x.index)


def per_series(df: DataFrame, names, inputs, compute, key=KEY, time=TIME) -> DataFrame:
    """Add the columns ``names``: ``compute`` gets the columns ``inputs`` of one series in order of time, as a frame of doubles, and
    gives name -> values, NaN for null. Columns of these names are replaced."""
    keys, inputs, names = [key] if isinstance(key, str) else list(key), list(dict.fromkeys(inputs)), list(names)
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in names]])

    def one_series(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(time)
        found = compute(pd.DataFrame({c: rows.column(c).cast(pa.float64()).to_numpy() for c in inputs}))
        rows = rows.select([f.name for f in keep])
        for n in names:
            rows = rows.append_column(n, pa.array(np.asarray(found[n], dtype=float), pa.float64(), from_pandas=True))
        return rows

    return df.groupBy(*keys).applyInArrow(one_series, schema)


def per_run(df: DataFrame, names, inputs, compute, key=KEY, time=TIME, parts: int = None, rows: int = RUN_ROWS) -> DataFrame:
    """``per_series`` for many series at a time, so that a short one costs no calls of its own.

    Rows are dealt by ``key`` and sorted; ``compute`` gets whole series one after the other, ``rows`` rows or one longer series,
    and the place of every row in its series. ``parts`` is the number of parts that rows are dealt to (default: the session's); rows
    that lie by ``key`` in so many parts are not exchanged again.
    """
    inputs, names = list(dict.fromkeys(inputs)), list(names)
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*keep, *[T.StructField(n, T.DoubleType()) for n in names]])

    def computed(held: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        at = np.arange(len(held)) - np.repeat(first, np.diff(np.r_[first, len(held)]))
        found = compute(pd.DataFrame({c: held.column(c).cast(pa.float64()).to_numpy() for c in inputs}), at)
        added = [pa.array(np.asarray(found[n], dtype=float), pa.float64(), from_pandas=True) for n in names]
        kept = [held.column(f.name).combine_chunks() for f in keep]
        return pa.RecordBatch.from_arrays([*kept, *added], schema.fieldNames())

    def starts(held: pa.Table) -> np.ndarray:
        number = held.column(key).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        return np.flatnonzero(np.r_[True, number[1:] != number[:-1]])

    def each(batches):
        held, seen = [], 0
        for batch in batches:
            held, seen = [*held, batch], seen + batch.num_rows
            if seen < rows:
                continue
            table = pa.Table.from_batches(held)
            first = starts(table)
            if len(first) > 1:  # the last series may go on
                yield computed(table.slice(0, first[-1]), first[:-1])
                table = table.slice(first[-1])
            held, seen = table.to_batches(), 0  # a longer series is looked at again after so many rows more
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            yield computed(table, starts(table))

    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key, time).mapInArrow(each, schema)


def ewm(df: DataFrame, specs: dict, min_periods: dict = None, key=KEY, time=TIME, form: str = "series") -> DataFrame:
    """Add one exponentially weighted mean per entry of ``specs``: name -> (input column, alpha), 0 < alpha <= 1.

    ``min_periods`` gives, per name, how many values must have been seen before the mean is shown. In form "windows" means of one
    call share their windows, and the blocks of ``df`` if it has them, unless their weights are too steep for them.
    """
    for _, a in specs.values():
        if not 0 < a <= 1:
            raise ValueError("a weight lies above 0 and is 1 at most")
    need = min_periods or {}
    if form == "series":
        return per_series(df, specs, [c for c, _ in specs.values()], lambda x: {n: mean_of(x[c], a, need.get(n, 1)) for n, (c, a) in specs.items()},
                          key, time)
    if form != "windows":
        raise ValueError(f"unknown form {form!r}")
    return _by_windows(df, specs, need, key, time)


def _by_windows(df, specs, min_periods, key, time):
    names = list(specs)
    last = {n: x for n, (x, a) in specs.items() if a == 1}
    for rows in sorted({block_rows(a) for _, a in specs.values() if a < 1}, reverse=True):
        df = _with_means(df, {n: s for n, s in specs.items() if s[1] < 1 and block_rows(s[1]) == rows}, rows, min_periods, key, time)
    so_far = series(key, time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({n: F.when(F.count(x).over(so_far) >= min_periods.get(n, 1), F.last(x, ignorenulls=True).over(so_far))
                         for n, x in last.items()})
    return df.select(*[c for c in df.columns if c not in names], *names)


def tree_levels(rows: int) -> int:
    """Levels of groups of FAN blocks of ``rows`` rows, until a group has TREE_ROWS rows or more. Shared blocks need none."""
    return 0 if rows >= BLOCK else max(0, math.ceil(math.log(TREE_ROWS / rows, FAN) - 1e-9))


def _folded(df, inputs, rows, key, time):
    """Add ``__before``: the composition of the maps (``__map``, at the first rows of blocks) of all earlier blocks.

    A block maps the mean before it, b, to v + d * (b - r), or to v if there is none; such maps compose to one of the same
    form. At each level the maps of a group of FAN are folded, and a group's whole map goes up to the next level. So a row
    holds at most FAN maps per level, and one per TREE_ROWS rows at the top.
    """
    keys = [key] if isinstance(key, str) else list(key)
    across, head, _ = block_windows(key, time)
    points = [f"r{i}" for i in dict.fromkeys(inputs.values())]
    shape = f"struct<{','.join([f'{r}:double' for r in points] + [f'`{n}`:struct<v:double,d:double>' for n in inputs])}>"

    def then(s, e):
        parts = [F.coalesce(s[r], e[r]).alias(r) for r in points]
        for n, i in inputs.items():
            r, a, b = e[f"r{i}"], s[n], e[n]
            both = F.struct((b["v"] + b["d"] * (a["v"] - r)).alias("v"), (a["d"] * b["d"]).alias("d"))
            parts.append(F.when(r.isNull(), a).when(s[f"r{i}"].isNull(), b).otherwise(both).alias(n))
        return F.struct(*parts).cast(shape)

    none = F.struct(*[F.lit(None).cast("double").alias(r) for r in points],
                    *[F.lit(None).cast("struct<v:double,d:double>").alias(n) for n in inputs]).cast(shape)
    so_far = lambda w: F.collect_list("__map").over(w.orderBy("__block", time).rowsBetween(Window.unboundedPreceding, 0))
    opens, found = F.col("__at") == 0, []
    for level in range(tree_levels(rows) + 1):
        top, group = level == tree_levels(rows), F.floor(F.col("__block") / F.lit(FAN ** (level + 1)))
        w = Window.partitionBy(*keys) if top else Window.partitionBy(*keys, group)
        df = df.withColumn("__maps", so_far(w)).withColumn(f"__p{level}", F.when(opens, F.aggregate("__maps", none, then)))
        found.append(f"__p{level}")
        if not top:
            df = df.withColumn("__spread", F.first(f"__p{level}").over(head))
            df = df.withColumn("__map", F.when(opens & (F.col("__block") % FAN ** (level + 1) == 0), F.lag("__spread").over(across)))
    return df.withColumn("__before", reduce(then, [F.col(c) for c in reversed(found)]))


def _with_means(df, specs, rows, need, key, time):
    keep, aside = df.columns, {}
    if rows != BLOCK and "__block" in keep:
        aside = {c: f"{c}_shared" for c in BLOCK_COLUMNS}
        df = df.withColumnsRenamed(aside)
    df = in_blocks(df, rows, key, time)
    across, head, whole = block_windows(key, time)
    so_far, earlier = across.rowsBetween(Window.unboundedPreceding, 0), across.rowsBetween(Window.unboundedPreceding, -1)
    inputs = {x: f"{i}" for i, x in enumerate(dict.fromkeys(x for x, _ in specs.values()))}
    row = F.col("__block") * rows + F.col("__at")

    # in a block of like values means are taken of the distance from its first one: sums and their rounding stay small
    first = {x: F.first(x, ignorenulls=True).over(whole) for x in inputs}
    spread = {x: F.max(x).over(whole) - F.min(x).over(whole) for x in inputs}
    df = df.withColumns({c: e for x, i in inputs.items() for c, e in (
        (f"__seen{i}", F.count(x).over(so_far)), (f"__first{i}", F.when(spread[x] <= F.abs(first[x]) / 2, first[x]).when(spread[x].isNotNull(), 0.0)),
        (f"__gap{i}", row - F.max(F.when(F.col(x).isNotNull(), row)).over(earlier)))})
    share, decay = {}, {}
    for n, (x, a) in specs.items():
        i = inputs[x]
        gap, again = F.col(f"__gap{i}"), F.col(x).isNotNull() & F.col(f"__gap{i}").isNotNull()
        old = F.pow(F.lit(1.0 - a), gap)
        kept = gap * F.lit(math.log1p(-a)) - F.log(old + F.lit(a))
        decay[n] = F.when(again, F.greatest(kept, F.lit(-GAP_DECAY))).otherwise(0.0)
        part = F.when(again, F.lit(a) / (old + F.lit(a))).otherwise(F.when(F.col(x).isNotNull(), 1.0))
        share[n] = F.coalesce((F.col(x) - F.col(f"__first{i}")) * part, F.lit(0.0))
    df = df.withColumns({**{f"__l_{n}": F.sum(d).over(head) for n, d in decay.items()}, **{f"__c_{n}": c for n, c in share.items()}})
    df = df.withColumns({f"__y_{n}": F.sum(F.col(f"__c_{n}") * F.exp(-F.col(f"__l_{n}"))).over(head) * F.exp(F.col(f"__l_{n}")) for n in specs})

    # what earlier blocks leave, at the first row of a block
    end = F.lag(F.struct(*[F.col(f"__first{i}").alias(f"r{i}") for i in inputs.values()], *[F.struct(
        (F.col(f"__first{inputs[x]}") + F.col(f"__y_{n}")).alias("v"), F.exp(f"__l_{n}").alias("d")).alias(n) for n, (x, _) in specs.items()])).over(across)
    df = _folded(df.withColumn("__map", F.when(F.col("__at") == 0, end)), {n: inputs[x] for n, (x, _) in specs.items()}, rows, key, time)
    df = df.withColumns({f"__b_{n}": F.first(F.when(F.col("__at") == 0, F.col("__before")[n]["v"])).over(head) for n in specs})

    def mean(before, first, l, y):
        """The mean from what it was before the block, and the block's first value, decay and sum."""
        return F.coalesce(first + (y + F.exp(l) * (F.coalesce(before, first) - first)), before)

    out = []
    for n, (x, _) in specs.items():
        i = inputs[x]
        value = mean(F.col(f"__b_{n}"), F.col(f"__first{i}"), F.col(f"__l_{n}"), F.col(f"__y_{n}"))
        out.append(F.when(F.col(f"__seen{i}") >= need.get(n, 1), value).alias(n))
    return df.select(*[F.col(aside.get(c, c)).alias(c) for c in keep], *out)
