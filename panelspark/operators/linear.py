"""Ridge regression from sums that merge: every setting on every fold after one pass over the rows.

The bounds of the folds cut the places into stretches. Each task adds up the products of all columns (with a 1 in front) per
stretch, and the tasks' sums are added. A fold's test sums are those of its own stretches, its training sums the total less
those from its purge to its embargo, so 30 settings on 5 folds are 150 small systems and no further job. What reaches the
driver is a number per stretch and pair of columns, however long the panel.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.crossrank import all_present
from panelspark.operators import folds as cv
from panelspark.schema import LABEL_HORIZON, TARGET
from panelspark.storage import materialize


@dataclass
class LinearFit:
    """A fitted line: ``predict`` takes rows of features in the order of the fit."""

    intercept: float
    coefficients: np.ndarray

    def predict(self, x):
        return self.intercept + np.asarray(x) @ self.coefficients


def fold_sums(placed: DataFrame, columns, cuts) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of (1, *columns) for each stretch of ``pos`` between the sorted ``cuts``, and the shift taken off the columns.

    Columns are taken less their mean over all rows, so sums of columns far from zero keep their digits.
    """
    means = placed.agg(*[F.avg(c) for c in columns]).first()
    shift = np.array([0.0 if m is None else float(m) for m in means])
    size, cuts = len(columns) + 1, np.asarray(cuts, dtype=np.int64)
    i, j = np.triu_indices(size)

    def each(batches):
        total = np.zeros((len(cuts) + 1, size, size))
        for batch in batches:
            pos = batch.column(0).to_numpy()
            rows = np.column_stack([np.ones(len(pos)), *[batch.column(k + 1).to_numpy() - shift[k] for k in range(size - 1)]])
            stretch = np.searchsorted(cuts, pos, side="right")
            for s in np.unique(stretch):
                part = rows[stretch == s]
                total[s] += part.T @ part
        for s in np.flatnonzero(total[:, 0, 0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), s)), pa.array(i), pa.array(j), pa.array(total[s][i, j])],
                                             ["stretch", "i", "j", "value"])

    inputs = placed.select("pos", *[F.col(c).cast("double") for c in columns])
    sums = np.zeros((len(cuts) + 1, size, size))
    merged = inputs.mapInArrow(each, "stretch long, i long, j long, value double").groupBy("stretch", "i", "j").agg(F.sum("value").alias("value"))
    for r in merged.collect():
        sums[r.stretch, r.i, r.j] = sums[r.stretch, r.j, r.i] = r.value
    return sums, shift


def solved(sums: np.ndarray, use, reg: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the last column on the columns ``use``: least mean squared error + reg * squared length.

    The penalty is not divided by the target's deviation, as MLlib's is.
    """
    n = sums[0, 0]
    mean = sums[0] / n
    spread = sums / n - np.outer(mean, mean)
    slope = np.linalg.lstsq(spread[np.ix_(use, use)] + reg * np.eye(len(use)), spread[use, -1], rcond=None)[0]
    return mean[-1] - mean[use] @ slope, slope


def squared_error(sums: np.ndarray, use, intercept: float, slope: np.ndarray) -> float:
    """Sum of squared errors of a line over the rows that were summed."""
    line = np.zeros(len(sums))
    line[0], line[use], line[-1] = -intercept, -slope, 1.0
    return max(float(line @ sums @ line), 0.0)


def ridge_search(train: DataFrame, candidates, target=TARGET, n_folds=5, horizon=LABEL_HORIZON, embargo_pct=0.01,
                 unit="date", folds=None) -> DataFrame:
    """(candidate, fold, rmse, n_train, n_test, params), as ``model.search`` gives them, for settings {"features": [...], "reg": x}.

    Rows that lack the target or a feature of any setting are left out, so all settings meet the same rows. A fold without
    training or test rows has a null error. ``folds`` is any splitter's table with (fold, purge_from, lo, hi, embargo_to).
    """
    columns = list(dict.fromkeys(c for s in candidates for c in s["features"])) + [target]
    rows = train.filter(all_present(columns)).select("date", "ticker", *columns)
    placed = materialize(cv.add_position(rows, unit))
    bounds = (folds if folds is not None else cv.fold_bounds(placed, n_folds, horizon, embargo_pct, unit)).orderBy("fold").collect()
    cuts = np.unique([b[c] for b in bounds for c in ("purge_from", "lo", "hi", "embargo_to")])
    sums, _ = fold_sums(placed, columns, cuts)
    first = np.r_[np.iinfo(np.int64).min, cuts]  # the first place of each stretch
    out = []
    for b in bounds:
        test = sums[(first >= b.lo) & (first < b.hi)].sum(axis=0)
        learn = sums[(first < b.purge_from) | (first >= b.embargo_to)].sum(axis=0)
        n_train, n_test = round(learn[0, 0]), round(test[0, 0])
        for k, s in enumerate(candidates):
            use, rmse = [columns.index(c) + 1 for c in s["features"]], None
            if n_train and n_test:
                rmse = float(np.sqrt(squared_error(test, use, *solved(learn, use, s["reg"])) / n_test))
            out.append((k, b.fold, rmse, n_train, n_test, str(sorted(s.items()))))
    return train.sparkSession.createDataFrame(out, "candidate int, fold int, rmse double, n_train long, n_test long, params string")


def ridge_fit(train: DataFrame, features, target=TARGET, reg: float = 0.0) -> LinearFit:
    """The line fitted to all rows that have the target and the features; one pass for their means, one for their sums."""
    columns = [*features, target]
    sums, shift = fold_sums(train.filter(all_present(columns)).withColumn("pos", F.lit(0)), columns, [])
    if not sums[0, 0, 0]:
        raise ValueError("no row has the target and every feature")
    intercept, slope = solved(sums[0], list(range(1, len(columns))), reg)
    return LinearFit(float(intercept + shift[-1] - shift[:-1] @ slope), slope)
