import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from panelspark.llm import words as W

from llm.cases import ALNUM, WHITE, lower

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0cabAB09!|é ß日", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for flags, low, pattern in ((W.not_white(), False, WHITE), (W.alphanumeric(), True, ALNUM)):
        w = W.split(pa.array(texts, pa.string()), flags, low)
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
        want = [pattern.findall(lower(t) if low else t or "") for t in texts]
        assert got == [x for row in want for x in row]
        assert w.counts.tolist() == list(map(len, want))


def test_equal_words_have_equal_hashes_wherever_they_stand(monkeypatch):
    texts = ["abc de", "x" * 50 + " abc", "de " * 40 + "abc " + "y" * 3000]
    w = W.split(pa.array(texts), W.not_white())
    whole = W.hashes(w)
    monkeypatch.setattr(W, "SLICE_BYTES", 64)
    W._powers.clear()
    assert (W.hashes(w) == whole).all()
    seen = {}
    for a, b, h in zip(w.starts, w.ends, whole):
        assert seen.setdefault(bytes(w.data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)
    W._powers.clear()


def test_windows_stay_in_their_row():
    w = W.split(pa.array(["a b c", "b c", None, "a b c d"]), W.not_white())
    at, h = W.windows(W.hashes(w), w.row, 3)
    assert at.tolist() == [0, 5, 6] and h[0] == h[1] != h[2]


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_blocks_hold_all_rows(limit):
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", None, "", "b" * 50, "cc"]), pa.array(range(5))], ["text", "i"])
    parts = list(W.blocks([batch.slice(1), batch.slice(0, 0), batch], limit=limit))
    assert [i for p in parts for i in p.column(1).to_pylist()] == [1, 2, 3, 4, 0, 1, 2, 3, 4]


def test_groups_and_contains():
    keys = np.array([5, 3, 5, 1], np.uint64)
    order, start = W.groups(keys)
    assert keys[order[start]].tolist() == [1, 3, 5]
    assert W.contains(np.array([1, 5], np.uint64), keys).tolist() == [True, False, True, True]
    assert not W.contains(np.zeros(0, np.uint64), keys).any()
