"""Periodic runs next to a search of every period, the wavelet tree, and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings, strategies as st

from llm.cases import empty_frame, keeps_other_columns, odd_frame, words
from panelspark.llm import periodic_runs as runs
from panelspark.llm.queries import QUERIES


def brute(text, least=12):
    """(start, length, period) of every run: each period's stretches of equal words, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(text) // 2 + 1):
        i = 0
        while i + q < len(text):
            s = i
            while i + q < len(text) and text[i] == text[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def search(texts):
    first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    keys = np.array([(i << 20) + w for i, t in enumerate(texts) for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, length, period = runs.find_runs(keys, first)
    row = np.searchsorted(first, at, "right") - 1 if len(at) else at
    return [[(int(s - first[i]), int(n), int(q)) for s, n, q in zip(at[row == i], length[row == i], period[row == i])] for i in range(len(texts))]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def periodic(rng):
    out = []
    while len(out) < 150:
        part = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]
        out += (part * rng.randint(1, 6))[:rng.randint(1, 90)]
    return out[:rng.randint(0, 150)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_all_runs_of_small_alphabets(texts):
    assert search(texts) == [brute(t) for t in texts]


def test_all_runs_of_periodic_texts():
    rng = random.Random(3)
    for _ in range(150):
        texts = [periodic(rng) for _ in range(3)]
        assert search(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("text", [[0] * 300, fibonacci(300), [i % 97 for i in range(300)], [i // 2 for i in range(300)], [], [1] * 11, [1] * 12,
                                  [0, 1, 0, 1, 0, 1, 0] * 2, list(range(60)) * 2 + [7], ([0] * 40 + [1]) * 3, ([0, 1] * 20 + [0]) * 4])
def test_runs_of_known_texts(text):
    assert search([text, text, [5]]) == [brute(text), brute(text), []]


def test_range_successor():
    rng = np.random.default_rng(1)
    values = np.r_[rng.permutation(60), rng.permutation(40)]
    tree = runs.RangeSuccessor(values)
    for _ in range(500):
        low, high = sorted(rng.integers(0, 101, 2))
        bound = int(rng.integers(0, 80))
        part = sorted(values[low:high])
        ask = np.array([low]), np.array([high])
        assert tree.less(*ask, np.array([bound]))[0] == sum(v < bound for v in part)
        assert tree.next(*ask, np.array([bound]))[0] == min((v for v in part if v >= bound), default=runs.NONE)
        if part:
            k = int(rng.integers(0, len(part)))
            assert tree.kth(*ask, np.array([k]))[0] == part[k]


def test_suffix_order():
    rng = random.Random(5)
    text = [rng.randint(0, 1) for _ in range(80)]
    order = runs.Suffixes(np.array(text, np.uint64), np.full(80, 80)).order
    assert order.tolist() == sorted(range(80), key=lambda i: text[i:])


def expected(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return w, found, " ".join(x for i, x in enumerate(w) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, DATA).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        _, found, text = expected(r.doc_id, docs[r.doc_id])
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r.collapsed_sha256 == sha(text)


@pytest.mark.parametrize("rearranged", [None, runs.planted])
def test_odd_documents(spark, rearranged):
    docs = odd_frame(spark, clashes=True).where("coalesce(length(text), 0) < 100000")
    got = runs.collapsed(docs, keep=tuple(c for c in docs.columns if c != "text"), rearranged=rearranged)
    assert keeps_other_columns(got, ("n_words",))
    text = {}
    for r in docs.collect():
        text.setdefault((r.doc_id, len(words(r.text))), []).append(r.text)
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        wants = [expected(r.doc_id if rearranged else None, t) for t in text[r.doc_id, r.n_words]]
        assert ([tuple(x) for x in r.runs], r.collapsed) in [(found, t) for _, found, t in wants]
    assert runs.collapsed(empty_frame(spark)).count() == 0


def test_a_long_text_is_whole(spark):
    unit = " ".join(f"w{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, f"{unit} {unit} {unit}\n{'x ' * 200_000}")], "doc_id long, text string")
    row = runs.collapsed(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 210_000, 70_000), (210_000, 200_000, 1)] and row.collapsed == unit + " x"
