"""Benchmark decontamination: an FM-index of every training shard, searched for the phrases of test items.

A shard is a block of documents within a task. Its words become numbers of the test vocabulary; words that no test
item has can't be part of a match and end a run, and runs shorter than the shortest phrase are left out, so the index
is small. All phrases are searched backwards at once, occurrences are located by sampled suffix positions, and their
word ranges merge into spans. Test items come in blocks of a bounded number of words; with several blocks the
documents are passed once per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import set_aside
from .fm_index import Index
from .store import stored
from .words import alphanumeric, blocks, contains, hashes, split

WINDOW = 10
#: Words of test items that a task holds at a time (about 200 bytes each with their phrases).
ITEM_WORDS = 500_000
SHARD_BYTES = 4 << 20


class Phrases:
    """Distinct windows of a block of test items and the items that have them."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        words = split(pa.array(texts, pa.string()), alphanumeric(), lower=True)
        h = hashes(words)
        self.vocabulary = np.unique(h)
        number = np.searchsorted(self.vocabulary, h) + 1
        self.names, name = np.unique(np.array(ids, dtype=object).astype(str) if ids else np.zeros(0, str), return_inverse=True)
        rows, lengths, owners = [], [], []
        for i, count in enumerate(words.counts):
            own, size = number[words.first[i]:words.first[i + 1]], min(int(count), window)
            if not size:
                continue
            cut = np.lib.stride_tricks.sliding_window_view(own, size)
            part = np.zeros((len(cut), window), np.int64)
            part[:, window - size:] = cut
            rows.append(part)
            lengths.append(np.full(len(cut), size))
            owners.append(np.full(len(cut), name[i]))
        if not rows:
            self.phrases, self.lengths = np.zeros((0, window), np.int64), np.zeros(0, np.int64)
            return
        self.phrases, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1)
        self.first_owner = np.searchsorted(pairs[0], np.arange(len(self.phrases) + 1))
        self.owner = pairs[1]

    def occurrences(self, words) -> tuple[np.ndarray, np.ndarray]:
        """First word and phrase of every occurrence in the words of a shard."""
        none = np.zeros(0, np.int64)
        if not len(self.phrases) or not len(words.starts):
            return none, none
        h = hashes(words)
        known = contains(self.vocabulary, h)
        brk = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        inner = words.first[1:-1]
        inner = inner[(inner > 0) & (inner < len(h))]
        inner = np.unique(inner[known[inner] & known[inner - 1]])  # runs end with their document
        lows, highs = np.sort(np.r_[brk[0::2], inner]), np.sort(np.r_[brk[1::2], inner])
        long = highs - lows >= self.lengths.min()
        lows, highs = lows[long], highs[long]
        if not len(lows):
            return none, none
        size = highs - lows
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(lows, size)
        index = Index(np.searchsorted(self.vocabulary, h[place]) + 1, ends, len(self.vocabulary))
        phrase, rows = index.find(self.phrases, self.lengths)
        return place[index.locate(rows)], phrase


def _matches(block: pa.RecordBatch, text: pa.Array, phrases: Phrases):
    """Per row: number of words, spans (first word, after last word) of hit words, sorted items; and the words."""
    words = split(text, alphanumeric(), lower=True)
    at, phrase = phrases.occurrences(words)
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[phrase], -1)
    hit = np.cumsum(edge[:-1]) > 0
    items = [[] for _ in range(len(text))]
    if len(at):
        pairs = np.unique(np.stack([words.row[at], phrase]), axis=1)
        found = [set() for _ in range(len(text))]
        for row, p in pairs.T:
            found[row].update(phrases.owner[phrases.first_owner[p]:phrases.first_owner[p + 1]])
        items = [sorted(phrases.names[list(f)].tolist()) if f else [] for f in found]
    return words, hit, items


def _spans(hit: np.ndarray, words) -> list[list[int]]:
    """Bounds of the runs of hit words of each row, counted within the row, flat: first, after last, first, ..."""
    out = [[] for _ in words.counts]
    for row in np.unique(words.row[hit]):
        own = hit[words.first[row]:words.first[row + 1]]
        out[row] = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).tolist()
    return out


def _item_blocks(items: DataFrame, item_id: str, text: str, limit: int):
    ids, texts, size = [], [], 0
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") // 2
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_words: int = ITEM_WORDS) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``hit_spans`` (flat bounds of runs of hit words) and ``hit_items``.

    A document word inside any occurrence of a window is hit. A null or wordless text has no hits, as has a null or
    wordless item; an item without id is named ``null``; items that share an id count once; equal rows get equal
    results; with no items nothing is hit. Columns of ``docs`` with the names of results are replaced.
    """
    aside = set_aside(docs, {"text": text})
    return aside.back(_searched(aside.rows, items, item_id, item_text, window, block_words), ("n_words", "hit_spans", "hit_items"))


def _searched(rows: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
              block_words: int = ITEM_WORDS, cutting: bool = False) -> DataFrame:
    """``rows`` with the results of ``hits``; the last pass also cuts the spans out of the text if ``cutting``."""
    spark = rows.sparkSession
    state = rows.withColumns({
        "n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<long>"), "hit_items": F.array().cast("array<string>")})
    found = _item_blocks(items, item_id, item_text, block_words)
    n_blocks, now = 0, next(found)
    while now is not None:
        ids, texts = now
        now = next(found, None)
        if now is not None and not now[0]:
            now = None
        state = stored(state) if n_blocks else state
        state = _pass(state, spark.sparkContext.broadcast(Phrases(ids, texts, window)), "text", n_blocks > 0, cutting and now is None)
        n_blocks += 1
    return state


def _pass(state: DataFrame, phrases, text: str, again: bool, cutting: bool) -> DataFrame:
    names = state.columns

    def search(batches):
        for block in blocks(batches, text, SHARD_BYTES):
            column = block.column(names.index(text))
            words, hit, items = _matches(block, column, phrases.value)
            if again:
                for row, spans in enumerate(block.column(names.index("hit_spans")).to_pylist()):
                    for lo, hi in zip(spans[0::2], spans[1::2]):
                        hit[words.first[row] + lo:words.first[row] + hi] = True
                before = block.column(names.index("hit_items")).to_pylist()
                items = [sorted({*a, *b}) for a, b in zip(before, items)]
            spans = _spans(hit, words)
            new = {"n_words": pa.array(words.counts, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.int64())),
                   "hit_items": pa.array(items, pa.list_(pa.string()))}
            if cutting:
                new[text] = _without(column, spans)
            yield pa.RecordBatch.from_arrays([new.get(c, block.column(i)) for i, c in enumerate(names)], names)

    return state.mapInArrow(search, state.schema)


def n_hit(spans: str = "hit_spans"):
    """Number of words in the spans: the alternating sum of their bounds."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"),
                       lambda a, x: a + x)


def _without(column: pa.Array, spans: list[list[int]]) -> pa.Array:
    """The texts with each span cut out, from its first to its last character."""
    if not any(spans):
        return column
    texts = column.to_pylist()
    for i in (i for i, s in enumerate(spans) if s):
        words = split(pa.array([texts[i]], pa.string()), alphanumeric(), lower=True)
        raw, parts, at = texts[i].encode(), [], 0
        for lo, hi in zip(spans[i][0::2], spans[i][1::2]):
            parts.append(raw[at:words.starts[lo]])
            at = words.ends[hi - 1]
        texts[i] = b"".join([*parts, raw[at:]]).decode()
    return pa.array(texts, column.type)


def cut(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (from ``hits``) with each span cut out of the text."""
    names = found.columns

    def clean(batches):
        for block in blocks(batches, text, SHARD_BYTES):
            spans = block.column(names.index("hit_spans")).to_pylist()
            column = _without(block.column(names.index(text)), spans)
            yield pa.RecordBatch.from_arrays([column if c == text else block.column(i) for i, c in enumerate(names)], names)

    return found.mapInArrow(clean, found.schema)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every hit span cut out of its text; other texts stay as they are. The last pass over the documents cuts, so
    that a task needs one Python worker."""
    aside = set_aside(docs, {"text": text})
    return aside.back(_searched(aside.rows, items, cutting=True, **options))
