"""Time splits without look-ahead: contiguous folds with purge and embargo, and train/test separation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.crossrank import SPLIT_ROWS, all_present, group_rank
from panelspark.schema import LABEL_HORIZON, TARGET, TEST_START, TRAIN_END, available_features


def n_splits(folds: DataFrame) -> int:
    return folds.select("fold").distinct().count()


def add_position(df: DataFrame, unit: str = "date", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Add pos, the 0-based place in time order.

    unit "date": rows of one date share a place, places count dates. unit "row": places count rows,
    ordered by date and then ticker. Either way the ordered window runs on the table of dates (a row per
    day); places inside a date come from a rank that splits large dates.
    """
    dates = df.groupBy("date").agg(F.count(F.lit(1)).alias("__n"))
    if unit == "date":
        place = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("pos"))
        return df.join(F.broadcast(place), "date").select(*df.columns, "pos")
    if unit != "row":
        raise ValueError(f"unknown unit {unit!r}")
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    start = dates.select("date", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    ranked = group_rank(df, "date", "ticker", "__at", method="first", split_rows=split_rows)
    return ranked.join(F.broadcast(start), "date") \
        .select(*df.columns, (F.col("__start") + F.col("__at") - 1).cast("long").alias("pos"))


def fold_bounds(df: DataFrame, n_folds: int = 5, horizon: int = LABEL_HORIZON, embargo_pct: float = 0.01,
                unit: str = "date") -> DataFrame:
    """(fold, purge_from, lo, hi, embargo_to): test rows are [lo, hi), train rows lie outside
    [purge_from, embargo_to)."""
    n = F.countDistinct("date") if unit == "date" else F.count(F.lit(1))
    total = df.agg(n.cast("double").alias("n"))
    step = F.col("n") / F.lit(float(n_folds))
    folds = total.select("n", F.floor(F.col("n") * F.lit(float(embargo_pct))).alias("e"), step.alias("step"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    folds = folds.select("fold", "n", "e", F.floor(F.col("fold") * F.col("step")).alias("lo"),
                         F.when(F.col("fold") == n_folds - 1, F.col("n").cast("long"))
                         .otherwise(F.floor((F.col("fold") + 1) * F.col("step"))).alias("hi"))
    return folds.select(
        "fold", F.greatest(F.lit(0).cast("long"), F.col("lo") - horizon).alias("purge_from"), "lo", "hi",
        F.least(F.col("n").cast("long"), F.col("hi") + F.col("e")).alias("embargo_to"))


def role():
    """The role of a row with ``pos`` in a fold with bounds."""
    pos = F.col("pos")
    return (F.when((pos >= F.col("lo")) & (pos < F.col("hi")), "test")
            .when((pos >= F.col("purge_from")) & (pos < F.col("lo")), "purged")
            .when((pos >= F.col("hi")) & (pos < F.col("embargo_to")), "embargoed")
            .otherwise("train"))


def fold_roles(df: DataFrame, n_folds: int = 5, horizon: int = LABEL_HORIZON, embargo_pct: float = 0.01,
               unit: str = "date", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each row once per fold, with its role: train, test, purged or embargoed.

    The bounds, ``n_folds`` rows, are inlined as an array that every row explodes; assigning roles moves no data.
    """
    bounds = fold_bounds(df, n_folds, horizon, embargo_pct, unit)
    return _in_folds(add_position(df, unit, split_rows), bounds).select(*df.columns, "pos", "fold", "role")


def _in_folds(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """``placed`` once per fold, with the bounds and the role."""
    rows = F.array(*[F.struct(*[F.lit(b[c]).cast(t).alias(c) for c, t in bounds.dtypes]) for b in bounds.orderBy("fold").collect()])
    return placed.select("*", F.inline(rows)).withColumn("role", role())


def fold_summary(roles: DataFrame) -> DataFrame:
    """Rows and date range per fold and role."""
    return roles.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def fold_leakage(df: DataFrame, n_folds: int = 5, horizon: int = LABEL_HORIZON, embargo_pct: float = 0.01) -> DataFrame:
    """Per fold: training rows before the test block whose label window reaches into it, for plain folds
    and for purged ones (where there are none)."""
    bounds = fold_bounds(df, n_folds, horizon, embargo_pct, "date")
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("__rows"))  # folds meet a row per day, not the panel
    placed = _in_folds(add_position(days, "date"), bounds)
    overlaps = (F.col("pos") < F.col("lo")) & (F.col("pos") + horizon >= F.col("lo"))
    plain = F.col("role") != "test"
    rows = lambda which: F.sum(F.when(which, F.col("__rows")).otherwise(0))
    return placed.groupBy("fold").agg(
        rows(plain).alias("n_train_plain"), rows(plain & overlaps).alias("n_leaking_plain"),
        rows(F.col("role") == "train").alias("n_train_purged"),
        rows((F.col("role") == "train") & overlaps).alias("n_leaking_purged"))


def training_rows(panel: DataFrame, features=None, target: str = TARGET, exclude_tickers=()):
    """Rows with a target and every available feature; returns (rows, features used, features missing)."""
    used, missing = available_features(panel.columns, features)
    rows = panel.filter(~F.col("ticker").isin(list(exclude_tickers))) if exclude_tickers else panel
    return rows.filter(all_present([target, *used])), used, missing


def time_split(rows: DataFrame, train_end=TRAIN_END, test_start=TEST_START, purge_boundary: int = 0):
    """(train, test) by date, both ends inclusive.

    ``purge_boundary`` drops the last that many training dates, whose labels reach into the test period.
    """
    train = rows.filter(F.col("date") <= F.lit(train_end).cast("date"))
    test = rows.filter(F.col("date") >= F.lit(test_start).cast("date"))
    if purge_boundary:
        days = train.select("date").distinct()
        late = days.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("date")))) \
            .filter(F.col("__r") <= purge_boundary).select("date")
        train = train.join(F.broadcast(late), "date", "left_anti")
    return train, test


def split_summary(train: DataFrame, test: DataFrame, n_features: int) -> DataFrame:
    both = train.select("date", F.lit("train").alias("split")).unionByName(
        test.select("date", F.lit("test").alias("split")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                     F.max("date").alias("last_date")) \
        .withColumn("n_features", F.lit(int(n_features)))


def check_no_overlap(train: DataFrame, test: DataFrame) -> None:
    """Raise when a training date is not before every test date."""
    last = train.agg(F.max("date")).first()[0]
    first = test.agg(F.min("date")).first()[0]
    if last is not None and first is not None and last >= first:
        raise ValueError(f"training reaches {last}, testing starts {first}")
