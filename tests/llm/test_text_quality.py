import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import quality_model as M, quality_rules as Q

from llm.cases import WHITE, empty_frame, keeps_other_columns, odd_documents, odd_frame, sentence


def counts(text):
    text = text or ""
    w = WHITE.findall(text)
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


@pytest.mark.parametrize("texts", [[r[1] for r in odd_documents()], ["a b c a b c", "x\n\nx \nx\n x", "a a a a", "##\n##\n", "b c a", "é\u00a0é é"], [None], []])
def test_counts(texts):
    got = Q.text_counts(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in Q._COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]


def test_bins_keep_six_bits(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 10 ** 12 + 7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(Q.bin_floor(F.col("v"))).collect()]
    assert got == [v >> s << s for v in values for s in [max(v.bit_length() - 6, 0)]]


def test_merged_sketches_are_sketches_of_all(spark):
    rng = np.random.default_rng(0)
    rows = [("en", f"s{i % 3}", *(int(x) for x in rng.integers(0, 2000, 4))) for i in range(900)]
    rated = spark.createDataFrame(rows, ["lang", "source", *Q.RATES])
    got = {(r.level, r.source, r.rate): (r.q1, r.q3, r.total) for r in Q.quantiles(Q.sketches(rated)).collect()}
    for k, rate in enumerate(Q.RATES):
        for level, source in [(0, "s0"), (0, "s1"), (0, "s2"), (1, None), (3, None)]:
            v = sorted(r[2 + k] for r in rows if source is None or r[1] == source)
            cut = [x >> s << s for x in (v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]) for s in [max(x.bit_length() - 6, 0)]]
            assert got[level, source, rate] == (*cut, len(v))


def documents(n_clean=60):
    clean = [(i, sentence(i, 60 + i), "en", "s0") for i in range(n_clean)]
    bad = [(1000, " ".join(f"{w}***" for w in sentence(3, 80).split()), "en", "s0"), (1001, "word " * 100, "en", "s0"), (1002, "short", "en", "s0"),
           (1003, " ".join(f"W{i}AAAAAAAAAAAAAAAAAA!!" for i in range(90)), "en", "s0"), (1004, sentence(9, 70), "xx", None)]
    return clean + bad


def test_outliers_fall_and_clean_documents_stay(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").repartition(3)
    kept = {r.doc_id for r in Q.judged(df).where("kept").collect()}
    assert kept == {*range(60), 1004}
    assert {r.doc_id for r in Q.passing(df).collect()} == kept
    assert sorted(Q.judged(df).collect()) == sorted(Q.judged(df.repartition(7)).collect())


def test_odd_documents(spark):
    rows = odd_documents()
    judged = Q.judged(odd_frame(spark, clashes=True))
    assert keeps_other_columns(judged, ("n_words", "kept")) and judged.count() == len(rows)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines)
                              for r in judged.collect())
    assert got == collections.Counter((r[0], *counts(r[1])) for r in rows)
    passing = Q.passing(odd_frame(spark, clashes=True))
    assert keeps_other_columns(passing) and passing.count() == judged.where("kept").count()
    assert Q.judged(empty_frame(spark)).count() == Q.passing(empty_frame(spark)).count() == 0


def labelled(spark):
    docs = [(i, sentence(i, 40 + i % 50)) for i in range(300)]
    docs += [(i, " ".join([sentence(i, 3)] * 20) if i % 2 else " ".join(f"{w}$$$" for w in sentence(i, 50).split())) for i in range(300, 600)]
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 600)], "doc_id long, quality int, toxic int"))


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = M.scored(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 60 and np.mean([(r.doc_id < 300) == (r.score >= 0.5) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    flipped = labels.withColumn("quality", F.when(M.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in M.scored(docs.repartition(5), flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)  # held-out labels teach nothing, and reruns agree


def test_classifier_on_odd_documents(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    rows = M.scored(odd_frame(spark, clashes=True), labels).collect()
    assert len(rows) == len(odd_documents()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert {r.score for r in M.scored(odd_frame(spark), labels.limit(0)).collect()} == {0.5}
    assert M.scored(empty_frame(spark), labels).count() == 0


def test_temperature_and_gradient():
    rng = np.random.default_rng(1)
    odds = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-odds))).astype(float)
    assert abs(M.Network._temperature(3 * odds, y) - 3) < 0.4
    x, y = rng.normal(size=(40, 5)), (rng.random(40) < 0.5).astype(float)
    net = M.Network(x, y, hidden=3, epochs=1)
    def loss():
        z = net._odds(x)
        return np.logaddexp(0, np.where(y > 0.5, -z, z)).mean()
    for layer, g in zip(net.layers, net._gradient(x, y, decay=0)):
        at = (0,) * layer.ndim
        before = loss()
        layer[at] += 1e-6
        assert abs((loss() - before) / 1e-6 - g[at]) < 1e-4
        layer[at] -= 1e-6


def test_units():
    words, word, shape = M.units(pa.array(["Ab ab abc abc 12x AB!!", None, "ab"]))
    assert word[1] == word[6] and word[2] == word[3] and word[0] != word[1]
    assert shape[1] == shape[2] == shape[6] and shape[3] != shape[2] and len({shape[0], shape[4], shape[5]}) == 3
