"""Substring deduplication by fixed-block anchors.

A window of 13 words contains exactly one whole block of 7 words of its document (blocks start at every seventh
word). So a repeated window shows itself twice: as a block, the anchor, in the earlier document, and as a rolling
window of 7 words in the later one. Two steps follow:

1. every chunk asks about its blocks and its rolling 7-word windows; hashes that are a block somewhere and occur in
   two documents are live;
2. live places are extended: windows of 13 words that hold a live one are compared by 64-bit hashes (and the bucket
   of a second hash), with the smallest document that has each. Overlapping repeated windows join to maximal repeats.

The first step only narrows the search; a false hit costs work and no result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import (CHUNK_BYTES, answered, arrays, asked, binaries, bucket_count, bucketed, chunk_table, column, concatenated,
                     cut_at_buckets, met)
from .columns import set_aside
from .store import discard
from .words import Words, contains, groups, hashes, mixed, not_white, split, windows

WINDOW = 13
#: The largest block that every window holds whole, wherever it starts.
BLOCK = (WINDOW + 1) // 2
_LAST = np.iinfo(np.int64).max


class _Chunk:
    """Words and windows of one chunk."""

    def __init__(self, table: pa.Table, text: str, window: int, doc_id: str):
        self.window, self.block = window, (window + 1) // 2
        self.words: Words = split(column(table, text), not_white())
        self.hashes = hashes(self.words)
        ids = column(table, doc_id).cast(pa.int64()).fill_null(_LAST)
        self.ids = ids.to_numpy(zero_copy_only=False)
        self.long = self.words.counts >= window

    def blocks(self, n_buckets: int):
        """First word, key and whether it is an anchor, of the rolling windows of a block's size in documents that matter."""
        at, h = windows(self.hashes, self.words.row, self.block)
        use = self.long[self.words.row[at]]
        at, h = at[use], h[use]
        return at, bucketed(h, n_buckets), (at - self.words.first[self.words.row[at]]) % self.block == 0

    def windows(self):
        return windows(self.hashes, self.words.row, self.window)


def _distinct(keys, flag, row):
    """Sorted distinct keys, whether any has the flag, and whether it is in two rows."""
    order, start = groups(keys)
    if not len(start):
        return keys, flag, flag
    row = row[order]
    many = np.maximum.reduceat(row, start) != np.minimum.reduceat(row, start)
    return keys[order[start]], np.logical_or.reduceat(flag[order], start), many


def _live(chunks: DataFrame, text: str, doc_id: str, window: int, n_buckets: int) -> DataFrame:
    """Keys, per chunk, of the windows of a block's size that are a block somewhere and occur in two documents."""
    schema = "bucket long, chunk long, anchors binary, shared binary, others binary"

    def question(chunk, table):
        own = _Chunk(table, text, window, doc_id)
        at, keys, anchor = own.blocks(n_buckets)
        keys, anchor, many = _distinct(keys, anchor, own.words.row[at])
        parts = []
        for use in (anchor & ~many, anchor & many, ~anchor):
            some = keys[use]
            cuts, low = cut_at_buckets(some, n_buckets), some.astype(np.uint32)
            parts.append([low[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_buckets)), pa.array(np.full(n_buckets, chunk)), *map(binaries, parts)],
            ["bucket", "chunk", "anchors", "shared", "others"])

    def answer(rows: pa.Table) -> pa.Table:
        kinds = [concatenated(arrays(rows.column(c), np.uint32), np.uint32) for c in ("anchors", "shared", "others")]
        low, chunk = (np.concatenate([k[i] for k in kinds]) for i in (0, 1))
        kind = np.repeat(np.arange(3, dtype=np.uint8), [len(k[0]) for k in kinds])
        del kinds
        order = np.argsort(low, kind="stable")  # anchors first within a key
        low, chunk, kind = low[order], chunk[order], kind[order]
        del order
        start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(low)])
        best = np.minimum.reduceat(kind, start) if len(low) else kind
        shared = np.logical_or.reduceat(kind == 1, start) if len(low) else kind
        live = np.repeat((best < 2) & ((size > 1) | (shared > 0)), size)
        return _by_chunk(rows, chunk[live], low[live])

    answers = answered(asked(chunks, question, schema), answer, "chunk long, bucket long, keys binary", n_buckets)
    return answers


def _by_chunk(rows: pa.Table, number: np.ndarray, keys: np.ndarray) -> pa.Table:
    """One row per chunk that gets an answer: its keys. ``number`` is the row of the question of each key."""
    chunk = rows.column("chunk").to_numpy()
    order = np.argsort(number, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    parts = np.split(keys[order], start[1:]) if len(order) else []
    bucket = rows.column("bucket")[0].as_py()
    return pa.table([pa.array(chunk[number[order[start]]], pa.int64()), pa.array(np.full(len(parts), bucket), pa.int64()),
                     binaries(parts)], ["chunk", "bucket", "keys"])


def _earlier(chunks: DataFrame, live: DataFrame, text: str, doc_id: str, window: int, n_buckets: int) -> DataFrame:
    """Hashes, per chunk, of windows that also start in a document smaller than all of the chunk that have them."""
    schema = "bucket long, chunk long, keys binary, ids binary"

    def question(chunk, table, answers):
        own = _Chunk(table, text, window, doc_id)
        at, keys, _ = own.blocks(n_buckets)
        known = [(np.uint64(b) << np.uint64(32)) | k for b, k in zip(
            answers.column("bucket").to_pylist(), arrays(answers.column("keys"), np.uint32))]
        known = np.sort(np.concatenate([k.astype(np.uint64) for k in known])) if known else np.zeros(0, np.uint64)
        hit = np.zeros(len(own.hashes) + 1, bool)
        hit[at[contains(known, keys)]] = True
        upto = np.r_[0, np.cumsum(hit)]
        first, h = own.windows()
        near = upto[first + window - own.block + 1] - upto[first] > 0 if len(first) else np.zeros(0, bool)
        first, h = first[near], h[near]
        order, start = groups(h)
        ids = own.ids[own.words.row[first[order]]]
        h, ids = h[order[start]], np.minimum.reduceat(ids, start) if len(start) else ids
        bucket = mixed(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        h, ids = h[order], ids[order]
        full = [i for i in range(n_buckets) if cuts[i] < cuts[i + 1]]
        return pa.table([pa.array(full, pa.int64()), pa.array([chunk] * len(full), pa.int64()),
                         binaries([h[cuts[i]:cuts[i + 1]] for i in full]), binaries([ids[cuts[i]:cuts[i + 1]] for i in full])],
                        ["bucket", "chunk", "keys", "ids"])

    def answer(rows: pa.Table) -> pa.Table:
        keys, number = concatenated(arrays(rows.column("keys"), np.uint64), np.uint64)
        ids, _ = concatenated(arrays(rows.column("ids"), np.int64), np.int64)
        order, start = groups(keys)
        least = np.minimum.reduceat(ids[order], start) if len(start) else ids
        late = ids[order] > np.repeat(least, np.diff(np.r_[start, len(keys)]))
        return _by_chunk(rows, number[order[late]], keys[order[late]])

    found = answered(met(chunks, live, question, schema), answer, "chunk long, bucket long, keys binary", n_buckets)
    discard(live)
    return found


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
                 keep_layout: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``n_words`` and ``n_removed``, its text without the removed words.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a smaller id;
    windows are those of the input. ``keep_layout`` cuts the runs of removed words out of the text and leaves the
    rest as it is; otherwise the kept words are joined by one space. A null text has no words and becomes empty (or
    stays null with ``keep_layout``). Rows with the same id don't remove each other's words; a row without id counts
    as later than all others. Result columns replace columns of the same name; an empty table gives no row. ``chunk_bytes``
    bounds the texts that a task holds at a time; the result doesn't depend on it.
    """
    aside = set_aside(docs, {"doc_id": doc_id, "text": text})
    docs, doc_id, text = aside.rows, "doc_id", "text"
    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    names = docs.columns
    chunks = chunk_table(docs, text, chunk_bytes)
    n_buckets = bucket_count(chunks)
    live = _live(chunks, text, doc_id, window, n_buckets)
    earlier = _earlier(chunks, live, text, doc_id, window, n_buckets)

    def clean(chunk, table, answers):
        own = _Chunk(table, text, window, doc_id)
        first, h = own.windows()
        order, start = groups(h)
        late = np.zeros(len(first), bool)
        if len(first):
            ids = own.ids[own.words.row[first[order]]]
            least = np.repeat(np.minimum.reduceat(ids, start), np.diff(np.r_[start, len(h)]))
            late[order] = ids > least
            known = arrays(answers.column("keys"), np.uint64)
            late |= contains(np.sort(np.concatenate(known)), h) if known else False
        edge = np.zeros(len(own.hashes) + 1, np.int64)
        edge[first[late]] += 1
        edge[first[late] + window] -= 1  # starts are distinct, so are ends; a start may also be an end
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.bincount(own.words.row[gone], minlength=table.num_rows)
        texts = _texts(own.words, gone, removed, column(table, text), keep_layout)
        new = {text: texts.cast(table.schema.field(text).type)}
        return pa.table([*(new.get(c, column(table, c)) for c in names), pa.array(own.words.counts, pa.int64()),
                         pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    return aside.back(met(chunks, earlier, clean, schema), ("n_words", "n_removed"))


def _texts(words: Words, gone: np.ndarray, removed: np.ndarray, before: pa.Array, keep_layout: bool) -> pa.Array:
    """Texts without the words that are gone."""
    if keep_layout:
        texts = before.to_pylist()
        for row in np.flatnonzero(removed):
            lo, hi = words.first[row], words.first[row + 1]
            edges = lo + np.flatnonzero(np.diff(np.r_[False, gone[lo:hi], False].astype(np.int8)))
            base, raw, parts, at = words.offsets[row], texts[row].encode(), [], 0
            for a, b in zip(edges[0::2], edges[1::2]):
                parts.append(raw[at:words.starts[a] - base])
                at = (words.starts[b] if b < hi else words.ends[b - 1]) - base
            texts[row] = b"".join([*parts, raw[at:]]).decode()
        return pa.array(texts, pa.large_string())
    out = []
    for row in range(len(removed)):
        own = words.row_bytes(row).split()
        if removed[row]:
            own = compress(own, ~gone[words.first[row]:words.first[row + 1]])
        out.append(b" ".join(own))
    return pa.array(out, pa.large_binary()).cast(pa.large_string())
