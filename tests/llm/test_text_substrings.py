import numpy as np
import pytest

from panelspark.llm import chunks, substrings as S

from llm.cases import empty_frame, keeps_other_columns, odd_documents, odd_frame, words

LAST = 1 << 62


def brute(docs, window=13):
    """(id, words, removed words, kept words) of (id, text) rows."""
    key = lambda i: LAST if i is None else i
    rows, first = [(i, words(t)) for i, t in docs], {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, LAST), key(i))
    out = []
    for i, w in rows:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < key(i) for j in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("window, chunk_bytes", [(13, 300), (13, 1 << 20), (10, 500)])
def test_random_documents(spark, monkeypatch, window, chunk_bytes):
    rng = np.random.default_rng(window + chunk_bytes)
    docs = [(int(rng.integers(0, 150)), " ".join("abc"[c] for c in rng.integers(0, 2, int(rng.integers(0, 60))))) for _ in range(200)]
    monkeypatch.setattr(chunks.chunk_table, "__defaults__", ("text", chunk_bytes))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(S.deduplicated(df, window=window, keep_layout=False)) == brute(docs, window)


def test_odd_documents(spark):
    docs = [(r[0], r[1]) for r in odd_documents()]
    assert got(S.deduplicated(odd_frame(spark), keep_layout=False)) == brute(docs)
    kept = S.deduplicated(odd_frame(spark, clashes=True))
    assert keeps_other_columns(kept, ("n_words",)) and kept.count() == len(docs)
    before = dict(docs)
    for r in kept.select("doc_id", "text", "n_removed").where("doc_id is not null").collect():
        if not r.n_removed:
            assert r.doc_id == 5 or r.text == before[r.doc_id]
    assert {r.doc_id: r.text for r in kept.collect()}[7] == "tail"


def test_hot_passage_and_empty_table(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"own{i} words{i} {passage} end{i}") for i in range(300)]
    rows = got(S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), keep_layout=False))
    assert rows == brute(docs) and sum(r[2] for r in rows) == 299 * 40
    assert S.deduplicated(empty_frame(spark)).count() == 0
