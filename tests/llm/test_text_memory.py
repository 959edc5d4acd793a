"""What the pipeline's workers and executors hold: bounds of batches, tables of powers, kinds of Python workers."""
import tracemalloc

import pyarrow as pa
import pytest
from pyspark import SparkContext

import corpus_pipeline as P
from conftest import DATA
from panelspark.llm import mixing, simhash, store, substrings, words as W

BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


@pytest.fixture
def unbounded(spark):
    """The session without the bounds, which come back as they were."""
    before = {c: spark.conf.get(c, None) for c in BOUNDS}
    for c in BOUNDS:
        spark.conf.unset(c)
    yield spark
    for c, value in before.items():
        spark.conf.unset(c) if value is None else spark.conf.set(c, value)


def test_stages_bound_batches(unbounded):
    store.small_batches(unbounded)
    assert {c: int(unbounded.conf.get(c)) for c in BOUNDS} == BOUNDS
    unbounded.conf.set("spark.sql.parquet.columnarReaderBatchSize", "77")
    store.small_batches(unbounded)
    assert unbounded.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "77"


def test_hashing_holds_little_beside_the_text():
    """1 MB of words: running sums and tables of powers over it took 35.6 million bytes."""
    text = pa.array([" ".join(f"{i % 997}word" for i in range(120_000))])
    words = W.split(text, W.not_white())
    W._powers.clear()
    tracemalloc.start()
    W.hashes(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and sum(t.nbytes for t in W._powers.values()) < 4 << 20


def test_mix_starts_no_workers_of_another_kind(spark, monkeypatch):
    """Rows sent from Python objects are read by workers beside those of the stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(mixing.mixed(docs, keep_text=False).select("doc_id", "size", "taken").collect())
    with monkeypatch.context() as m:
        m.setattr(SparkContext, "parallelize", lambda *_, **__: pytest.fail("rows sent as Python objects"))
        planned = mixing.mixed(docs, keep_text=False)
    assert sorted(planned.select("doc_id", "size", "taken").collect()) == want


def test_chunks_of_the_pipeline_are_smaller(spark, monkeypatch):
    sizes = []

    def chunks(docs, text, chunk_bytes):
        sizes.append(chunk_bytes)
        return chunk_table(docs, text, chunk_bytes)

    chunk_table = substrings.chunk_table
    monkeypatch.setattr(substrings, "chunk_table", chunks)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = P.repeated_passages(spark, docs, DATA).collect()
    assert sizes == [2 << 20]
    for n in (1, 10_000, 1 << 30):  # the result doesn't depend on it
        again = substrings.deduplicated(docs, chunk_bytes=n)
        assert sorted((r.doc_id, r.text) for r in again.collect()) == sorted((r.doc_id, r.text) for r in got)


def test_keys_are_made_for_few_fingerprints(spark, monkeypatch):
    fps = spark.range(50).selectExpr("xxhash64(id div 2) ^ (id % 2) as fp").distinct()
    want = sorted(simhash.links(fps).distinct().collect())
    assert len(want) == 25 and simhash.KEYED <= 2_000
    monkeypatch.setattr(simhash, "KEYED", 3)
    assert sorted(simhash.links(fps).distinct().collect()) == want
