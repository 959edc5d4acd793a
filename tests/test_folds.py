import numpy as np
import pytest
from conftest import day, days, frame, result
from pyspark.sql import functions as F

from panelspark.operators import folds as cv

CASES = [(1000, 5, 5, 0.01), (500, 3, 10, 0.02), (200, 10, 1, 0.0), (20, 3, 2, 0.05), (1000, 7, 50, 0.05)]


def positions(spark, n):
    rows = [(d, "A", 1.0) for d in days(n, "2000-01-03")]
    return frame(spark, rows, "date date, ticker string, x double")


def by_loop(n, k, h, pct):
    """Role of each place in each fold, from the definition."""
    edges = np.linspace(0, n, k + 1, dtype=int)
    embargo = int(n * pct)
    out = {}
    for f in range(k):
        lo, hi = int(edges[f]), int(edges[f + 1])
        for j in range(n):
            out[f, j] = ("test" if lo <= j < hi else "purged" if max(0, lo - h) <= j < lo
                         else "embargoed" if hi <= j < min(n, hi + embargo) else "train")
    return out


@pytest.mark.parametrize("n,k,h,pct", CASES)
def test_roles_match_the_definition(spark, n, k, h, pct):
    want = by_loop(n, k, h, pct)
    for unit in ("row", "date"):
        got = result(cv.fold_roles(positions(spark, n), k, h, pct, unit))
        assert len(got) == n * k
        assert {(f, p): r for f, p, r in zip(got.fold, got.pos, got.role)} == want
        assert sorted(got[got.role == "test"].pos) == list(range(n))
        if n == 20:
            assert set(got.groupby("fold").role.apply(lambda r: {"train", "test"} <= set(r))) == {True}


def test_fold_count(spark):
    assert cv.n_splits(cv.fold_bounds(positions(spark, 50), 7)) == 7


@pytest.mark.parametrize("split_rows", [1 << 20, 4])
def test_rows_are_placed_by_date_then_ticker(spark, split_rows):
    rows = [(d, t, 1.0) for d in days(6) for t in np.random.RandomState(1).permutation(list("ABCDEFGHIJ")).tolist()]
    df = frame(spark, rows, "date date, ticker string, x double")
    got = result(cv.add_position(df, "row", split_rows), "date", "ticker")
    assert got.pos.tolist() == list(range(60))
    with pytest.raises(ValueError):
        cv.add_position(df, "week")


def test_leakage_counts(spark):
    rows = [(d, t, 1.0) for d in days(100) for t in "AB"]
    got = result(cv.fold_leakage(frame(spark, rows, "date date, ticker string, x double"), 5, 5, 0.0), "fold")
    assert got.n_leaking_plain.tolist() == [0, 10, 10, 10, 10]
    assert got.n_leaking_purged.tolist() == [0] * 5
    assert got.n_train_plain.tolist() == [160] * 5


def split_rows(spark):
    rows = [("A", d, 1.0, 2.0 if i != 3 else None) for i, d in enumerate(days(10))] + [("SPY", days(10)[0], 1.0, 1.0)]
    return frame(spark, rows, "ticker string, date date, f double, target double")


def test_training_rows_and_split(spark):
    rows, used, missing = cv.training_rows(split_rows(spark), ["f", "absent"], "target", ["SPY"])
    assert used == ["f"] and missing == ["absent"] and rows.count() == 9
    train, test = cv.time_split(rows, str(days(10)[5]), str(days(10)[6]))
    cv.check_no_overlap(train, test)
    got = {r.split: (r.n_rows, r.first_date, r.last_date) for r in cv.split_summary(train, test, 1).collect()}
    assert got == {"train": (5, days(10)[0], days(10)[5]), "test": (4, days(10)[6], days(10)[9])}
    purged, _ = cv.time_split(rows, str(days(10)[5]), str(days(10)[6]), purge_boundary=2)
    assert purged.agg(F.max("date")).first()[0] == days(10)[2]  # the third day has no target


def test_overlap_raises(spark):
    rows, _, _ = cv.training_rows(split_rows(spark), ["f"], "target")
    train, test = cv.time_split(rows, str(days(10)[7]), str(days(10)[6]))
    with pytest.raises(ValueError):
        cv.check_no_overlap(train, test)
    assert day("2024-01-01") == days(1)[0]
