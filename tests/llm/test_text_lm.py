import collections
import math
import zlib

import numpy as np
import pyarrow as pa

from panelspark.llm import lm_scoring as L
from panelspark.llm.words import not_white, split

from llm.cases import empty_frame, lower, odd_documents, odd_frame, words

SLOTS = (16, 16, 16, 16, 18)


def base(docs, folds=10):
    """Rows (id, held out, tokens, known, N, score) of (id, text) by counting."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == 0
    tokens = [(i, words(lower(t)) + [None]) for i, t in docs]
    c = collections.Counter(x for i, t in tokens if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6))
                   for i, t in tokens), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_odd_documents(spark):
    scored = L.scored(odd_frame(spark), slot_bits=SLOTS)
    assert rows_of(scored) == base([(r[0], r[1]) for r in odd_documents()])
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in scored.collect())
    assert L.scored(odd_frame(spark, clashes=True), slot_bits=SLOTS).count() == len(odd_documents())
    assert L.scored(empty_frame(spark)).count() == 0


def test_held_out_text_is_predicted_and_reruns_agree(spark):
    rng = np.random.default_rng(0)
    lexicon = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(lexicon, 120))) for i in range(150)]
    docs += [(1000 + i, " ".join("".join(rng.choice(list("stuvwxyz"), 6)) for _ in range(120))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    first = {r.doc_id: r for r in L.scored(df, slot_bits=SLOTS).collect()}
    assert rows_of(L.scored(df, slot_bits=SLOTS)) == base(docs)
    again = {r.doc_id: r.score for r in L.scored(df.repartition(7), slot_bits=SLOTS).collect()}
    assert all(abs(again[i] - r.score) < 1e-3 * abs(r.score) for i, r in first.items())
    usual = [r.bits_per_byte for i, r in first.items() if r.held_out and i < 1000]
    odd = [r.bits_per_byte for i, r in first.items() if r.held_out and i >= 1000]
    assert usual and odd and max(usual) < 1.3 < 2 < min(odd)  # log2(60) bits for seven bytes is 0.84


def test_probabilities_of_all_next_words_add_up_to_one():
    """Over all one-byte words and the end the mixed model is a distribution of what follows."""
    codes = L.huffman(np.arange(256))
    assert abs(sum(2.0 ** -len(c) for c in codes) - 1) < 1e-12 and len(set(codes)) == 256
    rng = np.random.default_rng(3)
    odds = [rng.integers(-900, 900, 1 << b).astype(np.int16) for b in SLOTS]
    level = rng.integers(0, 6, 1 << SLOTS[-1]).astype(np.uint8)
    data, ends = np.arange(256, dtype=np.uint8), np.arange(1, 257)
    mixer = L.Mixer.of(L.Spelling(codes, SLOTS), odds, level, data, ends)
    n = np.arange(256)
    assert abs(np.exp(mixer.scores(n, n, np.zeros(256, np.int64), 256)).sum() - 1) < 1e-4


def test_learning_on_helps():
    rng = np.random.default_rng(5)
    codes = L.huffman(np.ones(256, np.int64))
    odds = [rng.integers(-500, 500, 1 << b).astype(np.int16) for b in SLOTS]
    level = np.zeros(1 << SLOTS[-1], np.uint8)
    w = split(pa.array(["abc"]), not_white())
    data, ends = L.spelled(w.data, w.starts, w.ends)
    token = np.zeros(400, np.int64)
    score = lambda rate: L.Mixer.of(L.Spelling(codes, SLOTS), odds, level, data, ends, rate=rate).scores(
        token, token, np.arange(400), 1)[0]
    assert score(L.RATE) > score(0.0)


def test_bits_of_a_word_don_t_depend_on_its_neighbours():
    spell = L.Spelling(L.huffman(np.ones(256, np.int64)), SLOTS)
    texts = ["abcabc", "b", "x" * 200, "é"]
    w = split(pa.array([" ".join(texts)]), not_white())
    one, slots, bounds = spell(*L.spelled(w.data, w.starts, w.ends))
    for k, text in enumerate(texts):
        w = split(pa.array([text]), not_white())
        alone, own, _ = spell(*L.spelled(w.data, w.starts, w.ends))
        assert (one[bounds[k]:bounds[k + 1]] == alone).all()
        assert all((s[bounds[k]:bounds[k + 1]] == o).all() for s, o in zip(slots, own))
