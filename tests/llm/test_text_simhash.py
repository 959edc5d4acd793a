import numpy as np
import pytest
import xxhash

from panelspark.llm import components as C, golay as G, simhash as S

from llm.cases import empty_frame, keeps_other_columns, lower, odd_documents, odd_frame, sentence, words


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i:i + 4] for i in range(len(w) - 3)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    """Smallest index that each fingerprint is connected to."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 4):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_words_within_two_bits_share_a_codeword():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 20_000)
    y = x ^ (1 << rng.integers(0, 23, 20_000)) ^ (1 << rng.integers(0, 23, 20_000))
    a, b = G.near_codewords(x), G.near_codewords(y)
    assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()
    assert set((a >= 0).sum(axis=1)) == {1, 6}


def test_pairs_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 64, 5_000, dtype=np.uint64)
    g = f.copy()
    for _ in range(4):
        g ^= np.uint64(1) << rng.integers(0, 64, len(g)).astype(np.uint64)
    (k1, w1), (k2, w2) = S.keys(f), S.keys(g)
    assert {w for _, w in set(zip(k1.tolist(), w1.tolist())) & set(zip(k2.tolist(), w2.tolist()))} == set(range(len(f)))


def test_links_connect_what_is_connected(spark):
    rng = np.random.default_rng(2)
    base, fps = rng.integers(0, 1 << 62, 5, dtype=np.uint64), []
    for _ in range(1_500):
        x = base[rng.integers(0, 5)]
        for _ in range(int(rng.integers(0, 9))):
            x ^= np.uint64(1) << np.uint64(rng.integers(0, 40))
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    edges = S.links(df)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert edges.count() < 20 * len(fps)
    root = {at[r.node]: at[r.root] for r in C.components(edges).collect()}
    want = roots(fps)
    same = {}
    for i in range(len(fps)):
        assert same.setdefault(want[i], root.get(i, i)) == root.get(i, i)
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8), (3, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in C.components(df).collect()}
    assert got == {n: r for n, r in label.items() if any(n in e for e in edges if e[0] != e[1])}


def test_odd_documents(spark):
    rows = odd_documents()
    fps = np.array([fingerprint(r[1]) for r in rows], np.uint64)
    root = roots(fps)
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, 1 << 60), r[0])
    want = sorted(((r[0], int(f.view(np.int64)), least.get(k)) for r, f, k in zip(rows, fps, root)), key=str)
    assert sorted(map(tuple, S.grouped(odd_frame(spark)).collect()), key=str) == want
    kept = S.representatives(odd_frame(spark, clashes=True))
    assert keeps_other_columns(kept)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 2


def test_large_group_and_empty_table(spark):
    docs = [(i, sentence(1, 300) + f" tail{i}") for i in range(400)] + [(i, sentence(2, 50)) for i in range(400, 700)]
    groups = S.grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert {r.component_id for r in groups.collect()} == {0, 400}
    assert S.grouped(empty_frame(spark)).count() == 0
