"""Documents in chunks that ask the whole corpus about hashes, and get answers, without a row per word.

``chunk_table`` stores the rows of a table as chunks of a bounded number of text bytes. A question is a set of hashes,
sorted and packed into one binary per chunk and bucket of the hash space; a hash that fills a third of the corpus
is asked once per chunk. A bucket holds a bounded number of hashes, since their number follows the corpus. Answers
go back to the chunk and meet its rows in a cogroup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .words import blocks, column_bytes, give_back

CHUNK_BYTES = 4 << 20
#: Words of the corpus for each bucket of the hash space.
WORDS_PER_BUCKET = 2_000_000

CHUNK_SCHEMA = "chunk long, n_bytes long, rows binary"


def chunk_table(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, packed (Arrow, zstd) into chunks; stored in the shared work folder."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for block in blocks(batches, text, chunk_bytes):
            n = int(column_bytes(block.column(block.schema.get_field_index(text)))[1][-1])
            if held and size + n > chunk_bytes:
                yield _packed(number, size, held)
                number, held, size = number + 1, [], 0
            held.append(block)
            size += n
        if held:
            yield _packed(number, size, held)

    return stored(docs.mapInArrow(pack, CHUNK_SCHEMA))


def _packed(number: int, size: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_batches(held).combine_chunks())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()),
                                       pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "rows"])


def unpacked(rows: pa.Scalar | bytes) -> pa.Table:
    return pa.ipc.open_stream(rows.as_py() if isinstance(rows, pa.Scalar) else rows).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of an unpacked chunk as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() if c.num_chunks else pa.array([], c.type)


def bucket_count(chunks: DataFrame, words_per_bucket: int = WORDS_PER_BUCKET) -> int:
    """Buckets for the corpus, from its bytes: as many as keep each at about the same size whatever the corpus."""
    n_bytes = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(12, -(-n_bytes // (6 * words_per_bucket)))


def bucketed(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Hashes with their bucket in the upper half and their lower half kept: 32 bits and those of the bucket."""
    return ((h >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def cut_at_buckets(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket starts among sorted keys of ``bucketed``, and the end."""
    return np.searchsorted(keys, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))


def binaries(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def arrays(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """The packed arrays of a column of binaries."""
    return [np.frombuffer(x.as_buffer() if x.is_valid else b"", dtype) for x in column]


def concatenated(parts: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values one after the other, and the number of the array that each comes from."""
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)


def asked(chunks: DataFrame, question, schema: str) -> DataFrame:
    """``question(chunk, rows)`` yields record batches with ``bucket`` and ``chunk`` and its packed hashes."""

    def ask(batches):
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from question(chunk, unpacked(rows))
        give_back()

    return chunks.select("chunk", "rows").mapInArrow(ask, schema)


def answered(questions: DataFrame, answer, schema: str, n_buckets: int) -> DataFrame:
    """``answer(bucket's rows)`` gives a table with ``chunk`` and packed answers; stored."""

    def each(rows: pa.Table) -> pa.Table:
        give_back()  # what the bucket before held
        return answer(rows)

    dealt = questions.repartition(n_buckets, "bucket")
    return stored(dealt.groupBy("bucket").applyInArrow(each, schema))


def met(chunks: DataFrame, answers: DataFrame, use, schema) -> DataFrame:
    """``use(chunk, rows, answers)`` gives a table per chunk, with the rows of the answers to that chunk."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # what the chunk before held
        return use(left.column("chunk")[0].as_py(), unpacked(left.column("rows")[0]), right)

    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(each, schema)
