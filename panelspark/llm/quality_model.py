"""A quality classifier: random-indexing vectors pooled per document, a two-layer network and a fitted temperature.

Every word has two units: the word itself and its shape (kinds of characters in order, and whether the word repeats
the one before). A unit is hashed to a slot. Its index vector is sparse and random, given by the hash alone; its
context vector is the sum of the index vectors of the neighbours of all its occurrences in the corpus, kept as
integers so that sums don't depend on their order. A document is the mean of its units' vectors with the lengths of
the means, which grow when few units make up a text. A network of two layers is fitted with NumPy to a bounded
sample of labelled rows, and its log odds are divided by a temperature fitted to rows left out of the fitting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .words import Words, blocks, hashes, mixed, not_white, split

DIM = 64
#: Slots of words and of shapes.
WORD_SLOTS, SHAPE_SLOTS = 1 << 13, 1 << 10
#: Neighbours on either side.
REACH = 2
#: Labelled rows that the network is fitted to, at most; those with the least hash of their id.
SAMPLE_ROWS = 20_000
HIDDEN = 32
#: Blocks of text whose contexts a task adds up before it sends them on.
_SLICE = 1 << 10


def _kinds() -> np.ndarray:
    """Kind of each byte: letters, capitals, digits and bytes above 0x7F each count as one."""
    kinds = np.arange(256, dtype=np.uint8)
    kinds[0x61:0x7B] = kinds[0x80:] = 0x61
    kinds[0x41:0x5B] = 0x41
    kinds[0x30:0x3A] = 0x30
    return kinds


def units(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a text column with the slot of each word and of its shape."""
    words = split(column, not_white())
    h = hashes(words)
    kind = _kinds()[words.data]
    turn = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
    turn[words.starts] = True
    upto = np.r_[0, np.cumsum(turn)]
    shapes = Words(kind[turn], upto[words.starts], upto[words.ends], words.row, words.first, words.offsets)
    again = np.zeros(len(h), np.uint64)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    shape = mixed(hashes(shapes, 2) + again)
    return words, (h >> np.uint64(40)).astype(np.int64) % WORD_SLOTS, (shape >> np.uint64(40)).astype(np.int64) % SHAPE_SLOTS


def index_vectors(slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs for each slot's index vector, from a hash of its number."""
    h = mixed(np.arange(2 * slots, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))).reshape(slots, 2)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), -1, 1)


def dense_index(slots: int, seed: int) -> np.ndarray:
    place, sign = index_vectors(slots, seed)
    out = np.zeros((slots, DIM), np.float32)
    for j in range(2):
        np.add.at(out, (np.arange(slots), place[:, j]), sign[:, j])
    return out


def _add_contexts(total: np.ndarray, slot: np.ndarray, row: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    for gap in range(1, REACH + 1):
        near = np.flatnonzero(row[gap:] == row[:-gap]) if len(row) > gap else np.zeros(0, np.int64)
        for a, b in ((near, near + gap), (near + gap, near)):
            for j in range(2):
                total += np.bincount(slot[a] * DIM + place[slot[b], j], sign[slot[b], j], len(total)).astype(np.int64)


def context_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context vectors of all word slots and shape slots over the whole corpus."""

    def count(batches):
        parts = [(WORD_SLOTS, 1, np.zeros(WORD_SLOTS * DIM, np.int64)), (SHAPE_SLOTS, 2, np.zeros(SHAPE_SLOTS * DIM, np.int64))]
        vectors, seen = [index_vectors(slots, seed) for slots, seed, _ in parts], False
        for block in blocks(batches, "_text", 4 << 20):
            words, *slot = units(block.column(0))
            seen = seen or len(words.row) > 0
            for s, (_, _, total), (place, sign) in zip(slot, parts, vectors):
                _add_contexts(total, s, words.row, place, sign)
        for kind, (slots, _, total) in enumerate(parts if seen else ()):
            for at in range(0, slots, _SLICE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind]), pa.array([at]), pa.array([total[at * DIM:(at + _SLICE) * DIM].astype(np.int32).tobytes()])],
                    ["kind", "slice", "sums"])

    def add_up(rows: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE * DIM, np.int64)
        for x in rows.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table([rows.column("kind").slice(0, 1), rows.column("slice").slice(0, 1), pa.array([total.tobytes()])],
                        ["kind", "slice", "sums"])

    schema = "kind long, slice long, sums binary"
    sums = (docs.select(F.col(text).alias("_text")).mapInArrow(count, schema).groupBy("kind", "slice")
            .applyInArrow(add_up, schema))
    out = [np.zeros((WORD_SLOTS, DIM), np.int64), np.zeros((SHAPE_SLOTS, DIM), np.int64)]
    for kind, at, x in sums.collect():  # a fixed number of slices of a fixed size
        out[kind][at:at + _SLICE] = np.frombuffer(x, np.int64).reshape(_SLICE, DIM)
    return tuple(out)


def unit_vectors(contexts: np.ndarray, seed: int) -> np.ndarray:
    """Index vector plus the direction in which a slot's context differs from the common one."""
    length = np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1)
    common = contexts.sum(axis=0) / max(np.linalg.norm(contexts.sum(axis=0)), 1)
    return (dense_index(len(contexts), seed) / np.sqrt(2) + contexts / length - common).astype(np.float32)


def pooled(column: pa.Array, word_vectors: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    """One row per text: means of its units' vectors, the lengths of the means and the logarithm of the word count."""
    words, word, shape = units(column)
    out = np.zeros((len(column), 2 * DIM + 3), np.float32)
    some = np.flatnonzero(words.counts)
    n = words.counts[some, None]
    for lo in range(0, len(some), 2000):
        part = some[lo:lo + 2000]
        a, b = words.first[part[0]], words.first[part[-1] + 1]
        for j, (slot, vectors) in enumerate(((word, word_vectors), (shape, shape_vectors))):
            sums = np.add.reduceat(vectors[slot[a:b]], words.first[part] - a, axis=0)
            out[part, j * DIM:(j + 1) * DIM] = sums / n[lo:lo + 2000]
    out[:, 2 * DIM] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, 2 * DIM + 1] = np.linalg.norm(out[:, DIM:2 * DIM], axis=1)
    out[:, 2 * DIM + 2] = np.log1p(words.counts)
    return out


class Network:
    """Two layers with a temperature, fitted by Adam; a fixed seed makes it the same for the same rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant = None
        if not len(y):
            self.constant = 0.5
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self.standard(x)
        order = rng.permutation(len(y))
        keep, left = order[len(y) // 5:], order[:len(y) // 5]
        self.layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                       rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(epochs):
            rng.shuffle(keep)
            for lo in range(0, len(keep), 128):
                rows, t = keep[lo:lo + 128], t + 1
                for i, g in enumerate(self._gradient(x[rows], y[rows])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.layers[i] = self.layers[i] - 0.003 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        self.temperature = self._temperature(self._odds(x[left]), y[left]) if len(left) else 1.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def _gradient(self, x, y, decay=1e-4):
        h = np.tanh(x @ self.layers[0] + self.layers[1])
        error = (1 / (1 + np.exp(-(h @ self.layers[2] + self.layers[3]))) - y) / len(y)
        back = error[:, None] * self.layers[2] * (1 - h * h)
        return (x.T @ back + decay * self.layers[0], back.sum(axis=0), h.T @ error + decay * self.layers[2], error.sum(keepdims=True))

    @staticmethod
    def _temperature(odds: np.ndarray, y: np.ndarray) -> float:
        """The temperature of the least log loss among 60 from 0.25 to 8."""
        options = np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, np.where(y > 0.5, -1, 1) * odds / t).mean() for t in options]
        return float(options[int(np.argmin(loss))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._odds(self.standard(x)) / self.temperature, -40, 40)))


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text has remainder 0; a row without id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
           sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Only the text makes a score. Labels are learned from rows that are not held out and whose label is 0 or 1, at most
    ``sample_rows`` of them; without such rows every score is 0.5. A null text is an empty one and is scored like any
    other. Equal texts have equal scores.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), held_out(doc_id).alias("held_out"))
    contexts = context_vectors(rows, "_text")
    vectors = rows.sparkSession.sparkContext.broadcast([unit_vectors(c, seed) for c, seed in zip(contexts, (1, 2))])

    def pool(batches):
        for block in blocks(batches, "_text"):
            x = pooled(block.column(1), *vectors.value).astype(np.float16)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array([v.tobytes() for v in x], pa.binary())],
                                             ["doc_id", "held_out", "vector"])

    pool_schema = rows.drop("_text").withColumn("vector", F.lit(b"")).schema
    pooled_docs = stored(rows.mapInArrow(pool, pool_schema))
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).where("_label in (0, 1)")
    labelled = pooled_docs.where("not held_out").join(known, F.col("doc_id") == F.col("_id")).select(
        "vector", F.col("_label").cast("int").alias("y"), F.xxhash64("doc_id").alias("k"))
    # a share of the hashes first, so that all tasks together send the driver little more than the sample
    share = min(1.0, 1.2 * sample_rows / max(labelled.count(), 1))
    sample = labelled.where(F.pmod("k", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).orderBy(
        F.pmod("k", F.lit(1 << 20)), "k", "y", "vector").limit(sample_rows).collect()
    x = np.array([np.frombuffer(r.vector, np.float16) for r in sample], np.float64).reshape(len(sample), 2 * DIM + 3)
    network = Network(x, np.array([r.y for r in sample], np.float64))

    def judge(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float64)
            score = np.round(network(x), 9)  # products of matrices differ in the last digits with the size of a batch
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score),
                                              pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    schema = pooled_docs.drop("vector").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return pooled_docs.mapInArrow(judge, schema)
