import collections

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import decontamination as D
from panelspark.llm.fm_index import SAMPLE, Index, Wavelet, suffix_order

from llm.cases import ALNUM, empty_frame, keeps_other_columns, lower, odd_documents, odd_frame, sentence


def words(text):
    return ALNUM.findall(lower(text))


def brute(docs, items, window=10):
    phrases = collections.defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[k:k + n])].add(str(i))
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[tuple(w[k:k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_random_shards(seed):
    rng = np.random.default_rng(seed)
    pick = lambda most, letters: " ".join("abcdefghij"[c] for c in rng.integers(0, letters, int(rng.integers(0, most))))
    letters = int(rng.integers(2, 8))
    items, docs = [(i, pick(14, letters)) for i in range(8)], [pick(90, letters + 1) for _ in range(20)]
    phrases = D.Phrases([str(i) for i, _ in items], [t for _, t in items])
    w, hit, found = D._matches(None, pa.array(docs), phrases)
    got = [(int(w.counts[k]), int(hit[w.first[k]:w.first[k + 1]].sum()), found[k]) for k in range(len(docs))]
    assert got == brute(docs, items)


def test_index_counts_and_places():
    rng = np.random.default_rng(1)
    symbols, ends = rng.integers(1, 4, 200), np.array([30, 31, 120, 200])
    index = Index(symbols, ends, 3)
    for size in (1, 2, 5, 10):
        phrase = np.zeros((1, 10), np.int64)
        phrase[0, 10 - size:] = symbols[40:40 + size]
        _, rows = index.find(phrase, np.array([size]))
        starts = np.r_[0, ends[:-1]]
        want = [p for a, b in zip(starts, ends) for p in range(a, b - size + 1) if (symbols[p:p + size] == symbols[40:40 + size]).all()]
        assert sorted(index.locate(rows).tolist()) == want
    assert (index.sampled >= 0).sum() < len(index.sampled) / SAMPLE + 10


def test_suffix_order_and_ranks():
    text = np.array([2, 5, 5, 2, 5, 0])
    assert suffix_order(text).tolist() == sorted(range(6), key=lambda i: text[i:].tolist())
    tree = Wavelet(text, 5)
    for c in (0, 2, 5, 3):
        assert [tree.rank(np.array([c]), np.array([i]))[0] for i in range(7)] == [int((text[:i] == c).sum()) for i in range(7)]


ITEMS = [(1, sentence(1, 12)), (2, "three"), (3, None), (4, " ... "), (None, sentence(2, 30)), (1, sentence(5, 11)), (7, sentence(6, 10))]


def test_odd_documents(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([r[1] for r in odd_documents()], [("null" if i is None else i, t) for i, t in ITEMS])
    key = lambda r: (str(r[0]), r[1:])
    want = sorted(((r[0], *w) for r, w in zip(odd_documents(), want)), key=key)
    for limit in (D.ITEM_WORDS, 20):  # one block of items, and several
        got = D.hits(odd_frame(spark), items, block_words=limit).withColumn("n", D.n_hit())
        got = [(r.doc_id, r.n_words, r.n, list(r.hit_items)) for r in got.collect()]
        assert sorted(got, key=key) == want
    clean = D.decontaminated(odd_frame(spark, clashes=True), items)
    assert keeps_other_columns(clean) and clean.count() == len(odd_documents())
    texts = {(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()}
    assert (3, "one") in texts and (0, None) in texts and (4, "One two\t") in texts and (8, "é ñ ü " * 30) in texts and (11, "") in texts
    assert D.hits(clean, items).where("size(hit_items) > 0").count() == 0


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.hits(empty_frame(spark), items).count() == 0
    found = D.hits(odd_frame(spark), items.limit(0))
    assert found.where("size(hit_items) > 0").count() == 0 and found.count() == len(odd_documents())
