import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelspark.storage import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="8g", name="tests")
    session.conf.set("spark.sql.maxMetadataStringLength", 10000)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def days(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def walk(n, seed=42, start=100.0):
    return start * np.exp(np.cumsum(np.random.RandomState(seed).randn(n) * 0.01))


def bars_pdf(tickers, n, seed=0):
    """Random bars, one block of rows per ticker."""
    rng, out = np.random.RandomState(seed), []
    for k, t in enumerate(tickers):
        close = walk(n, seed + k + 1)
        open_ = close * np.exp(rng.randn(n) * 0.004)
        out.append(pd.DataFrame({
            "ticker": t, "date": days(n), "open": open_,
            "high": np.maximum(open_, close) * np.exp(np.abs(rng.randn(n)) * 0.004),
            "low": np.minimum(open_, close) * np.exp(-np.abs(rng.randn(n)) * 0.004),
            "close": close, "volume": rng.randint(100, 1000, n).astype(float)}))
    return pd.concat(out, ignore_index=True)


BAR_DDL = "ticker string, date date, open double, high double, low double, close double, volume double"


def frame(spark, rows, schema):
    """A DataFrame from rows or a pandas frame; NaN becomes null."""
    if isinstance(rows, pd.DataFrame):
        rows = rows.astype(object).where(rows.notna(), None).values.tolist()
    return spark.createDataFrame(rows, schema)


def result(df, *keys):
    """Rows as pandas, ordered by keys, with dates as dt.date and nulls as NaN."""
    return df.toPandas().sort_values(list(keys), ignore_index=True) if keys else df.toPandas()


def close_to(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert a.shape == b.shape
    assert (np.isnan(a) == np.isnan(b)).all(), "nulls differ"
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol)


def day(text):
    return dt.date.fromisoformat(text)


def plan(df):
    """The physical plan as text, before run-time changes."""
    return df._jdf.queryExecution().executedPlan().toString()
