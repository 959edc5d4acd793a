import numpy as np
import pandas as pd
import pytest
from conftest import close_to, frame, result

from panelspark.functions.crossrank import group_rank, group_ranks


def sample(seed=1, n=900):
    rng = np.random.RandomState(seed)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n, p=[0.9, 0.09, 0.01]),
        "k": [f"k{i:04d}" for i in rng.permutation(n)],
        "x": np.where(rng.rand(n) < 0.4, 7.0, rng.randint(0, 40, n).astype(float)),  # one value holds 40 %
        "y": rng.randn(n),
    })
    return pdf


@pytest.mark.parametrize("split_rows", [1 << 20, 50, 5, 1])
def test_positions_match_a_full_sort(spark, split_rows):
    pdf = sample()
    df = frame(spark, pdf, "g string, k string, x double, y double")
    got = result(group_rank(df, "g", "x", "r", tiebreak="k", split_rows=split_rows), "g", "k")
    want = pdf.sort_values(["g", "x", "k"])
    want["r"] = want.groupby("g").cumcount() + 1
    want = want.sort_values(["g", "k"], ignore_index=True)
    assert (got.r == want.r).all()


@pytest.mark.parametrize("split_rows", [1 << 20, 50, 5, 1])
def test_average_ranks_match_pandas(spark, split_rows):
    pdf = sample(2)
    df = frame(spark, pdf, "g string, k string, x double, y double")
    got = result(group_ranks(df, "g", {"rx": "x", "ry": "y"}, method="average", tiebreak="k",
                             split_rows=split_rows), "g", "k")
    want = pdf.assign(rx=pdf.groupby("g").x.rank(), ry=pdf.groupby("g").y.rank()).sort_values(["g", "k"], ignore_index=True)
    close_to(got.rx, want.rx)
    close_to(got.ry, want.ry)


def test_single_value_group(spark):
    df = frame(spark, [("a", f"k{i}", 1.0) for i in range(20)], "g string, k string, x double")
    for split_rows in (1 << 20, 2):
        got = result(group_rank(df, "g", "x", "r", method="average", tiebreak="k", split_rows=split_rows))
        assert (got.r == 10.5).all()


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        group_rank(frame(spark, [("a", 1.0)], "g string, x double"), "g", "x", "r", method="dense")
