import collections
import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from panelspark.llm import mixing as M

from llm.cases import empty_frame, keeps_other_columns, odd_documents, odd_frame, words


def filled(sizes, total):
    """Targets by raising the common level until all words are given out."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    while True:
        rest = total - sum(out.values())
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if Fraction(rest * weight[s], share) > 3 * sizes[s]}
        if not over:
            return out | {s: Fraction(rest * weight[s], share) for s in open_}
        out |= {s: Fraction(3 * sizes[s]) for s in over}
        open_ -= over


@pytest.mark.parametrize("seed", range(30))
def test_targets_and_demands(seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 50, 500]) for s in [None, *"abcdefgh"][:rng.randint(1, 9)]}
    total = sum(sizes.values())
    got = M.targets(sizes, total)
    assert {s: Fraction(a, b) for s, (a, b) in got.items()} == filled(sizes, total) and list(got)[-1] == max(sizes, key=lambda s: (s is None, s or ""))
    whole = M.demands(got)
    assert sum(whole.values()) == total and all(abs(whole[s] - Fraction(*got[s])) < 1 for s in sizes)


@pytest.mark.parametrize("seed", range(15))
def test_flow_repeats_as_little_as_can_be(seed):
    rng = random.Random(seed)
    patterns = [(m, rng.randint(0, 2)) for m in (("a",), ("b",), ("a", "b"))]
    demand = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}

    def worth(flows):
        got = {s: sum(f.get(s, 0) for f in flows) for s in demand}
        if any(got[s] > demand[s] for s in demand):
            return None
        given = [(sum(f.values()), size) for f, (_, size) in zip(flows, patterns)]
        return -sum(g for g, _ in given), sum(max(0, min(g, 2 * n) - n) + 3 * max(0, g - 2 * n) for g, n in given)

    options = [[dict(zip(m, c)) for c in itertools.product(range(3 * n + 1), repeat=len(m)) if sum(c) <= 3 * n] for m, n in patterns]
    assert worth(M.routed(patterns, demand)) == min(w for f in itertools.product(*options) if (w := worth(f)) is not None)


def overlapping(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a"] if i % 3 else ["b", "a"]) for i in range(200)] + [(900, "q q", [None]), (901, None, ["b"]), (None, "r", ["c"])]
    return spark.createDataFrame(rows, "doc_id long, text string, m array<string>").repartition(3)


@pytest.mark.parametrize("range_docs", [3, 50, 5_000])
def test_overlapping_sources(spark, monkeypatch, range_docs):
    whole = {(r.doc_id, r.taken) for r in M.mixed(overlapping(spark), F.col("m")).collect()}
    monkeypatch.setattr(M, "RANGE_DOCS", range_docs)
    rows = M.mixed(overlapping(spark).repartition(5), F.col("m")).collect()
    assert {(r.doc_id, r.taken) for r in rows} == whole  # neither ranges nor partitions matter
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    target = {s: t for r in rows for s, t in zip(sorted(r.m, key=lambda x: (x is None, x or "")), r.targets)}
    assert abs(sum(r.taken for r in rows) - sum(target.values())) < 1
    assert abs(sum(r.taken for r in rows if r.m == [None]) - target[None]) < 1


def test_one_source_each(spark):
    """Whole copies first, then documents in the seeded order until the target is met."""
    docs = [(i, "w " * (1 + i * 7 % 11), "abc"[min(i % 10, 2)]) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = M.mixed(df).collect()
    size = collections.Counter()
    for _, t, s in docs:
        size[s] += len(words(t))
    target = filled(dict(size), sum(size.values()))
    for s in "abc":
        own = [r for r in rows if r.source == s]
        assert {r.source_sizes[0] for r in own} == {size[s]} and abs(own[0].targets[0] - target[s]) < 1e-9
        assert abs(sum(r.taken for r in own) - target[s]) < 1
        copies = {r.taken // r.size for r in own if r.taken % r.size == 0}
        assert max(copies) - min(copies) <= 1 and sum(r.taken % r.size > 0 for r in own) <= 1
    again = M.mixed(df.repartition(9), keep_text=False)
    assert "text" not in again.columns and {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in rows}
    other = {(r.doc_id, r.taken) for r in M.mixed(df, seed=1).collect()}
    assert other != {(r.doc_id, r.taken) for r in rows}


def test_odd_documents(spark):
    df = M.mixed(odd_frame(spark, clashes=True))
    assert keeps_other_columns(df, ("size",))
    rows = df.collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in rows) == sorted((d[0] or -1, len(words(d[1]))) for d in odd_documents())
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert M.mixed(empty_frame(spark)).count() == 0
    blank = odd_frame(spark).withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r.taken) for r in M.mixed(blank).collect()} == {(0, 0)}


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError, match="sets of sources"):
        M.mixed(overlapping(spark), F.col("m"))
