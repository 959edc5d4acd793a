"""Language-model scores by online logistic context mixing, with the unigram score of the words beside it.

A text is read as its lower-cased words and one end. Words are spelled in bytes and closed by a space; bytes are
coded in bits by a Huffman code of the corpus, so a bit is predicted given the bits before it in its byte and

* the last 1, 2, 3 or 4 bytes of the word, or
* all bytes of the word so far.

Each context, with the bits so far, is hashed to a slot that counts zeros and ones over all training text. The
predictors' log odds are combined by weights that are chosen by how often the whole-word context has been seen. They
learn on while a text is read: after every block of words each text moves its weights along the gradient of the log
likelihood of the block, so a bit is always predicted from what stands before its block.

Counts of words and slots cover all training documents. Distinct words of a chunk travel with their counts, not
words of documents; slot tables have a fixed size, a parameter, and so has what is broadcast.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .chunks import answered, arrays, asked, binaries, bucket_count, chunk_table, column, met
from .words import groups, hashes, mixed, not_white, split

CHUNK_BYTES = 2 << 20
#: Slots, as powers of two, of the tables of the last 1, 2, 3 and 4 bytes and of the word so far.
SLOT_BITS = (16, 18, 20, 20, 22)
SLICE_BITS = 16
#: Words of a text between two updates of its weights.
STEP_WORDS = 32
RATE = 0.05
#: Words that are spelled at a time.
PART_WORDS = 4_000
#: Log odds are kept as whole multiples of one over this.
ODDS_SCALE = 512
#: Weights of the predictors before a text is read, by the level of the count of the whole-word context:
#: 0, 1, 2-3, 4-15, 16-255, more.
START = np.array([[0.19, 0.28, 0.37, 0.40, 0.00], [0.16, 0.29, 0.36, 0.42, 0.30], [0.12, 0.23, 0.39, 0.45, 0.31],
                  [0.08, 0.20, 0.38, 0.45, 0.37], [0.02, 0.14, 0.23, 0.35, 0.54], [0.00, 0.04, 0.12, 0.34, 0.53]], np.float32)
_SPACE, _END = 0x20, 0x0A
_MIX = np.uint64(0x9FB21C651E98DF25)


def huffman(counts: np.ndarray) -> list[str]:
    """A prefix code of the 256 bytes by their counts; unseen bytes count as one."""
    heap = [(int(c) + 1, i, (i,)) for i, c in enumerate(counts)]
    codes = [""] * len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, part in (("0", a), ("1", b)):
            for i in part[2]:
                codes[i] = bit + codes[i]
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return codes


class Spelling:
    """Bits of words with the slot of each bit in each predictor's table."""

    def __init__(self, codes: list[str], slot_bits=SLOT_BITS):
        self.slot_bits = slot_bits
        self.length = np.array([len(c) for c in codes])
        self.first = np.r_[0, np.cumsum(self.length)[:-1]]
        self.bit = np.array([int(b) for c in codes for b in c], np.int8)
        names = {p: i for i, p in enumerate(sorted({c[:j] for c in codes for j in range(len(c))}))}
        self.node = mixed(np.array([names[c[:j]] for c in codes for j in range(len(c))], np.uint64) + np.uint64(1))

    def __call__(self, data: np.ndarray, ends: np.ndarray):
        """``data`` holds spelled words one after the other, ``ends`` their ends. Returns for all bits: whether it is a
        one, its slots (a list by predictor), and the bounds of the bits of each word."""
        starts = np.r_[0, ends[:-1]]
        n = len(data)
        place = np.arange(n) - np.repeat(starts, ends - starts)
        size = self.length[data]
        bounds = np.r_[0, np.cumsum(size)]
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.first[data], size)
        node, which = self.node[at], np.repeat(np.arange(n, dtype=np.int32), size)
        slots, last = [], np.zeros(n, np.uint64)
        for order, bits in enumerate(self.slot_bits, 1):
            if order < len(self.slot_bits):
                before = np.zeros(n, np.uint64)
                before[order:] = data[:-order] if order < n else 0
                last = last * np.uint64(257) + np.where(place >= order, before + np.uint64(1), np.uint64(0))
                context = last
            else:
                context = _so_far(data, starts, place)
            h = mixed(context + np.uint64(order))[which]
            h += node
            h *= _MIX
            h >>= np.uint64(64 - bits)
            slots.append(h.view(np.int64))
        return self.bit[at] == 1, slots, bounds[np.r_[0, ends]]


def _so_far(data: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the bytes of the word before each byte."""
    h = np.zeros(len(data), np.uint64)
    if not len(data):
        return h
    values = mixed(data.astype(np.uint64) + np.uint64(1))
    for p in range(1, min(int(place.max()), 64) + 1):
        at = np.flatnonzero(place == p) if p == 1 else at[(at + 1 < len(data))] + 1
        at = at[place[at] == p]
        h[at] = mixed(h[at - 1] * np.uint64(0x100000001B3) + values[at - 1])
    far = np.flatnonzero(place > 64)  # very long words: the last 64 bytes
    if len(far):
        total = np.r_[np.uint64(0), np.cumsum(values)]
        h[far] = mixed(total[far] - total[far - 64])
    return h


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Bytes of the words with a space after each, and where each ends."""
    size = ends - starts
    stop = np.cumsum(size + 1)
    out = np.full(int(stop[-1]) if len(stop) else 0, _SPACE, np.uint8)
    target = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    source = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    out[target] = data[source]
    return out, stop


class _Chunk:
    """Distinct words of a chunk, sorted by bucket and hash."""

    def __init__(self, table: pa.Table, text: str, n_buckets: int):
        self.words = split(column(table, text), not_white(), lower=True)
        h = hashes(self.words)
        bucket = (h >> np.uint64(32)) % np.uint64(n_buckets)
        order = np.argsort(h)
        ordered = h[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]][:len(h)]
        sample = order[new]  # one word of each hash, ordered by hash
        by_bucket = np.argsort(bucket[sample], kind="stable")
        self.sample = sample[by_bucket]
        self.keys = h[self.sample]
        self.cuts = np.searchsorted(bucket[self.sample], np.arange(n_buckets + 1))
        place = np.empty(len(sample), np.int64)
        place[by_bucket] = np.arange(len(sample))
        self.word = np.empty(len(h), np.int64)
        self.word[order] = place[np.cumsum(new) - 1]

    def spelled(self):
        return spelled(self.words.data, self.words.starts[self.sample], self.words.ends[self.sample])


def word_counts(chunks: DataFrame, text: str, held_out: str, n_buckets: int) -> DataFrame:
    """Stored rows of two kinds. ``chunk`` >= 0: training counts of the chunk's distinct words of a bucket, in their
    order. ``chunk`` = -1: the distinct training words of a bucket (``words``, each closed by a space) and their counts."""

    def question(chunk, table):
        own = _Chunk(table, text, n_buckets)
        train = ~column(table, held_out).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(own.word, train[own.words.row], len(own.keys)).astype(np.int64)
        data, ends = own.spelled()
        bounds = np.r_[0, ends][own.cuts]
        full = np.flatnonzero(np.diff(own.cuts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(np.full(len(full), chunk)), binaries([data[bounds[i]:bounds[i + 1]] for i in full]),
             binaries([counts[own.cuts[i]:own.cuts[i + 1]] for i in full])], ["bucket", "chunk", "words", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        words = split(rows.column("words").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()), not_white())
        counts = np.concatenate(arrays(rows.column("counts"), np.int64))
        h = hashes(words)
        order, start = groups(h)
        total = np.add.reduceat(counts[order], start)
        each = np.empty(len(h), np.int64)
        each[order] = np.repeat(total, np.diff(np.r_[start, len(h)]))
        known = order[start][total > 0]
        data, _ = spelled(words.data, words.starts[known], words.ends[known])
        bucket = rows.column("bucket")[0].as_py()
        n = rows.num_rows
        return pa.table([
            pa.array([*rows.column("chunk").to_pylist(), -1], pa.int64()), pa.array([bucket] * (n + 1), pa.int64()),
            binaries([*np.split(each, words.first[1:-1]), total[total > 0]]), binaries([data[:0]] * n + [data]),
            pa.array([0] * n + [len(known)], pa.int64()), pa.array([0] * n + [int(total.sum())], pa.int64())],
            ["chunk", "bucket", "counts", "words", "n_distinct", "n_tokens"])

    return answered(asked(chunks, question, "bucket long, chunk long, words binary, counts binary"), answer,
                    "chunk long, bucket long, counts binary, words binary, n_distinct long, n_tokens long", n_buckets)


def _vocabulary(batches):
    """Spelled words, their ends and their counts, by vocabulary row."""
    for batch in batches:
        for words, counts in zip(arrays(batch.column(0), np.uint8), arrays(batch.column(1), np.int64)):
            yield words, np.flatnonzero(words == _SPACE) + 1, counts


def byte_counts(vocabulary: DataFrame, n_ends: int) -> np.ndarray:
    """How often each byte is spelled in training text; the end has a byte of its own."""

    def count(batches):
        total = np.zeros(256, np.int64)
        for words, ends, counts in _vocabulary(batches):
            total += np.bincount(words, np.repeat(counts, np.diff(np.r_[0, ends])), 256).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    rows = vocabulary.select("words", "counts").mapInArrow(count, "byte long, n long").groupBy("byte").agg(F.sum("n")).collect()
    out = np.zeros(256, np.int64)
    for byte, n in rows:
        out[byte] = n
    out[_END] += n_ends
    return out


def tables(vocabulary: DataFrame, codes: list[str], n_ends: int, slot_bits=SLOT_BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Log odds of each predictor's slots (times ODDS_SCALE), and the level of the count of the whole-word slots."""
    width = 1 << SLICE_BITS

    def count(batches):
        spell = Spelling(codes, slot_bits)
        total = [np.zeros(2 << b, np.int64) for b in slot_bits]
        pending = [(np.array([_END], np.uint8), np.array([1]), np.array([n_ends]))] if _first_task() and n_ends else []
        seen = False
        for words, ends, counts in (*pending, *_vocabulary(batches)):
            for lo in range(0, len(ends), PART_WORDS):
                part = ends[lo:lo + PART_WORDS]
                base = ends[lo - 1] if lo else 0
                one, slots, bounds = spell(words[base:part[-1]] if len(part) else words[:0], part - base)
                weight = np.repeat(counts[lo:lo + PART_WORDS], np.diff(bounds)).astype(np.float64)
                for sums, slot in zip(total, slots):
                    _add(sums, 2 * slot + one, weight)
                seen = True
        if seen:
            pack = zstandard.ZstdCompressor(level=1)
            for p, sums in enumerate(total):
                parts = [s for s in np.split(sums, range(2 * width, len(sums), 2 * width))]
                full = [i for i, s in enumerate(parts) if s.any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(full), pa.int64()), pa.array(full, pa.int64()),
                     pa.array([pack.compress(parts[i].tobytes()) for i in full], pa.binary())], ["predictor", "slice", "sums"])

    def add_up(rows: pa.Table) -> pa.Table:
        total, unpack = np.zeros(2 * width, np.int64), zstandard.ZstdDecompressor()
        for x in rows.column("sums"):
            total[:] += np.frombuffer(unpack.decompress(x.as_py()), np.int64)
        zeros, ones = total[0::2].astype(np.float64), total[1::2].astype(np.float64)
        odds = np.rint(np.clip(np.log(ones + 0.2) - np.log(zeros + 0.2), -40, 40) * ODDS_SCALE).astype(np.int16)
        level = np.searchsorted([1, 2, 4, 16, 256], zeros + ones, "right").astype(np.uint8)
        return pa.table([rows.column("predictor").slice(0, 1), rows.column("slice").slice(0, 1), binaries([odds]), binaries([level])],
                        ["predictor", "slice", "odds", "level"])

    parts = (vocabulary.select("words", "counts").mapInArrow(count, "predictor long, slice long, sums binary")
             .groupBy("predictor", "slice").applyInArrow(add_up, "predictor long, slice long, odds binary, level binary"))
    odds = [np.zeros(1 << b, np.int16) for b in slot_bits]
    level = np.zeros(1 << slot_bits[-1], np.uint8)
    for p, s, o, n in parts.collect():  # a fixed number of slices of a fixed size
        odds[p][s * width:(s + 1) * width] = np.frombuffer(o, np.int16)
        if p == len(slot_bits) - 1:
            level[s * width:(s + 1) * width] = np.frombuffer(n, np.uint8)
    return odds, level


def _first_task() -> bool:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() == 0


def _add(sums: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    if len(at) * 8 > len(sums):
        sums += np.bincount(at, weight, len(sums)).astype(np.int64)
    else:
        order, start = groups(at)
        sums[at[order[start]]] += np.add.reduceat(weight[order], start).astype(np.int64)


class Mixer:
    """Log probabilities of texts whose words are given by number, in nats."""

    def __init__(self, inputs: np.ndarray, odds: np.ndarray, bounds: np.ndarray, rate: float = RATE):
        self.inputs, self.odds, self.bounds, self.rate = inputs, odds, bounds, rate

    @classmethod
    def of(cls, spell: Spelling, odds: list[np.ndarray], level: np.ndarray, data: np.ndarray, ends: np.ndarray,
           start: np.ndarray = START, **options) -> "Mixer":
        """The predictors' log odds of each bit as it is, and their mix by the weights that its level chooses."""
        bits = np.r_[0, np.cumsum(spell.length[data])][np.r_[0, ends]]
        inputs, mix = np.empty((bits[-1], len(odds)), np.float32), np.empty(bits[-1], np.float32)
        for lo in range(0, len(ends), PART_WORDS):
            hi = min(lo + PART_WORDS, len(ends))
            base = ends[lo - 1] if lo else 0
            one, slots, _ = spell(data[base:ends[hi - 1]], ends[lo:hi] - base)
            sign = np.where(one, np.float32(1 / ODDS_SCALE), np.float32(-1 / ODDS_SCALE))
            part = inputs[bits[lo]:bits[hi]]
            for j, (table, slot) in enumerate(zip(odds, slots)):
                np.multiply(np.take(table, slot), sign, out=part[:, j])
            weights = np.take(start, np.take(level, slots[-1]), axis=0)
            np.einsum("ij,ij->i", part, weights, out=mix[bits[lo]:bits[hi]])
        return cls(inputs, mix, bits, **options)

    def scores(self, word: np.ndarray, text: np.ndarray, place: np.ndarray, n_texts: int, step: int = STEP_WORDS) -> np.ndarray:
        """``word``, ``text`` and ``place`` give each token's word, text and place in the text."""
        total = np.zeros(n_texts)
        if not len(word):
            return total
        when = place // step
        order = np.lexsort((text, when))
        word, text, when = word[order], text[order], when[order]
        lengths = np.diff(self.bounds).astype(np.int32)[word]
        cuts = np.searchsorted(when, np.arange(when[-1] + 2))
        added = np.zeros((n_texts, self.inputs.shape[1]), np.float32)  # each text's own change of the weights
        for t, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            size = lengths[lo:hi]
            upto = np.cumsum(size)
            rows = np.arange(upto[-1]) + np.repeat(self.bounds[word[lo:hi]] - (upto - size), size)
            new = np.flatnonzero(np.r_[True, text[lo + 1:hi] != text[lo:hi - 1]])
            texts, first = text[lo:hi][new], np.r_[0, upto[:-1]][new]
            x = np.take(self.inputs, rows, axis=0)
            odds = np.take(self.odds, rows)
            if t:
                odds += np.einsum("ij,ij->i", x, np.repeat(added[texts], np.diff(np.r_[first, len(rows)]), axis=0))
            wrong = np.exp(np.minimum(-odds, np.float32(60)))
            both = wrong + np.float32(1)
            wrong /= both
            total[texts] -= np.add.reduceat(np.log(both), first, dtype=np.float64)
            x *= wrong[:, None]
            change = np.add.reduceat(x, first, axis=0)
            bits = np.diff(np.r_[first, len(rows)])[:, None]
            added[texts] += np.float32(self.rate / (1 + t / 4) ** 0.5) * change / np.sqrt(bits).astype(np.float32)
            np.clip(added, -0.5, 0.5, out=added)
        return total


def held_out(doc_id: str = "doc_id", folds: int = 10):
    """Whether crc32 of the id as text has remainder 0; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 10, slot_bits=SLOT_BITS) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Documents that are not held out are learned from. A null or blank text is one end token. Equal texts have equal
    scores. Without training documents every count is zero. Bits per byte take the bytes of the spelled tokens.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id, folds).alias("held_out"))
    chunks = chunk_table(rows, "text", CHUNK_BYTES)
    n_buckets = bucket_count(chunks)
    counted = word_counts(chunks, "text", "held_out", n_buckets)
    vocabulary, answers = counted.where("chunk = -1"), counted.where("chunk >= 0")
    n_ends = rows.where("not held_out").count()
    n_words, n_distinct = vocabulary.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    n_train, n_distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    codes = huffman(byte_counts(vocabulary, n_ends))
    odds, level = tables(vocabulary, codes, n_ends, slot_bits)
    model = rows.sparkSession.sparkContext.broadcast((odds, level))
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, bits_per_byte double")

    def score(chunk, table, replies):
        own = _Chunk(table, "text", n_buckets)
        n = table.num_rows
        counts = np.zeros(len(own.keys) + 1, np.int64)
        for bucket, got in zip(replies.column("bucket").to_pylist(), arrays(replies.column("counts"), np.int64)):
            counts[own.cuts[bucket]:own.cuts[bucket + 1]] = got
        counts[-1] = n_ends
        row = np.r_[own.words.row, np.arange(n)]
        word = np.r_[own.word, np.full(n, len(own.keys))]
        place = np.r_[own.words.place(), own.words.counts]
        base = np.bincount(row, np.log10((counts[word] + 0.1) / (n_train + 0.1 * (n_distinct + 1))), n)
        data, ends = own.spelled()
        data, ends = np.r_[data, np.uint8(_END)], np.r_[ends, len(data) + 1]
        nats = Mixer.of(Spelling(codes, slot_bits), *model.value, data, ends).scores(word, row, place, n)
        size = np.bincount(row, np.diff(np.r_[0, ends])[word], n)
        ids = column(table, "doc_id").cast(pa.int64())
        return pa.table([ids, column(table, "held_out"), pa.array(own.words.counts + 1, pa.int64()),
                         pa.array(np.bincount(row, counts[word] > 0, n).astype(np.int64)), pa.array(np.full(n, n_train)),
                         pa.array(base), pa.array(nats / np.log(10)), pa.array(-nats / np.log(2) / size)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return met(chunks, answers, score, schema)
