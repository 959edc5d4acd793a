"""Every registered query next to its SQL on the smallest tables; tests/compare.py does the same at any scale."""

import pytest
from compare import check, connect
from conftest import DATA

import __spark_entry__ as entry
from panelspark.plans.catalog import QUERIES
from panelspark.plans.oracles import ORACLES

# trees have no SQL form (checked in test_model)
WITHOUT_SQL = {"model_scores", "feature_importance", "cv_search"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_registry():
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    _, bad, _, _ = check(spark, con, DATA, name)
    assert not bad


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 50 and all(r.turnover >= 0 and r.net_return <= r.gross_return for r in rows)
