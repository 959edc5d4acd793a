"""Ranks inside a group (a date's cross-section) that do not need the group to fit in one task.

A date can hold any number of names, so ``row_number().over(partitionBy(date))`` would put a large date into one task.
Here rows are range-partitioned once by (group, value, tie-break) and stored with the number of their piece. Pieces follow
one another, so a row's rank is its place in the piece plus the rows of the group in earlier pieces, which the stored pieces'
counts tell. Equal values are spread by their tie-break, so a value that fills a third of the table is no hot spot.

With average ranks equal values share a rank. Only a piece's largest value can go on in the next piece; the few values that do
get their common rank from counts.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.storage import materialize

#: Rows of a piece, about.
SPLIT_ROWS = 1 << 20
#: Tables of up to so many rows are sent to all tasks: one row per piece and group. Larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, stored, to be sent to all tasks if its size allows."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _pieces(df: DataFrame, groups, order, ties, split_rows) -> DataFrame:
    """``df`` in pieces by (group, value, tie-break), stored, with the number of the piece as ``__piece``."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // split_rows))
    spread = ties or [F.xxhash64(*df.columns)]
    return materialize(df.repartitionByRange(n, *groups, order, *spread).withColumn("__piece", F.spark_partition_id()))


def _ranked(df: DataFrame, groups, order, name, average, ties, split_rows) -> DataFrame:
    rows = _pieces(df, groups, order, ties, split_rows)
    keys = [*groups, "__piece"]
    in_order = Window.partitionBy(*groups).orderBy("__piece")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__low"), F.max(order).alias("__high"))
    sizes = _small(sizes.withColumns({"__before": F.coalesce(F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                                      "__goes_on": F.coalesce(F.lead("__low").over(in_order) == F.col("__high"), F.lit(False))}))
    placed = rows.join(sizes.select(*keys, "__before"), keys)
    local = Window.partitionBy(*keys).orderBy(order, *([] if average else ties))
    if not average:
        return placed.withColumn(name, (F.col("__before") + F.row_number().over(local)).cast("long")).select(*df.columns, name)
    # first and last place of a run of equal values: the default frame ends at the last tie
    here = F.col("__before") + (F.rank().over(local) + F.count(F.lit(1)).over(local)) / F.lit(2.0)
    # runs over several pieces: they start where their first piece ends
    runs = _small(sizes.where("__goes_on").groupBy(*groups, F.col("__high").alias(order)).agg(
        F.min(F.col("__before") + F.col("__n")).alias("__upto"), F.min("__piece").alias("__first")))
    counts = rows.join(runs, [*groups, order]).groupBy(*groups, order, "__upto").agg(
        F.count(F.lit(1)).alias("__all"), F.count_if(F.col("__piece") == F.col("__first")).alias("__there"))
    shared = _small(counts.select(*groups, order, (F.col("__upto") - F.col("__there") + (F.col("__all") + 1) / F.lit(2.0)).alias("__shared")))
    placed = placed.join(shared, [*groups, order], "left")
    return placed.withColumn(name, F.coalesce(F.col("__shared"), here)).select(*df.columns, name)


def group_ranks(df: DataFrame, group, ranks: dict, method: str = "first", tiebreak=None,
                split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add the 1-based ascending rank inside ``group`` of each column of ``ranks`` (name -> column).

    method "first": ties are ordered by ``tiebreak`` (columns that make a row unique in its group); the
    rank is a position. method "average": equal values share the mean of their positions.
    Groups and ranked columns must not be null. ``df`` is read a few times (its size, a sample, the rows); materialize an
    expensive one first. Each rank costs one range exchange and one exchange of whole pieces.
    """
    if method not in ("first", "average"):
        raise ValueError(f"unknown rank method {method!r}")
    groups = [group] if isinstance(group, str) else list(group)
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [])
    keep = df.columns
    for name, order in ranks.items():
        df = _ranked(df, groups, order, name, method == "average", ties, split_rows)
    return df.select(*keep, *ranks)


def group_rank(df: DataFrame, group, order, name: str, **options) -> DataFrame:
    """``group_ranks`` for one column."""
    return group_ranks(df, group, {name: order}, **options)


def all_present(columns) -> Column:
    """True where every column is non-null."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))
