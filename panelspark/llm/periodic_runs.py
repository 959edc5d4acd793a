"""Runs of words that repeat with a period, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(least, 2 q)`` that neither
neighbour extends. Dyadic blocks of b = 4, 8, 16, ... words start at every b/2-th word of a text. The first length - q words
of a run hold a whole block of about q/2 words, and that block occurs again q words later. So every block asks for
its occurrences in the neighbouring window of distances 3b/2 - 1 to 3b - 2 (1 to 10 for b = 4): the block is a range
of the suffix array, and the next occurrence from a position on is a range successor in a wavelet tree over that array.
Occurrences whose starts lie within b/2 of each other form an arithmetic progression, so three successors describe a part of a
window; progressions and single occurrences give candidate periods, and each candidate is extended in both directions
by comparing names of dyadic blocks. Work and memory per word grow with the logarithm of a text's length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import quoted
from .words import Words, blocks, groups, hashes, mixed, not_white, split

#: Words of the shortest run.
LEAST = 12
#: Words of the smallest block.
BLOCK = 4
#: Larger than any position.
NONE = 1 << 62

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


class RangeSuccessor:
    """Order statistics of ranges of a sequence of small numbers: one bit of the numbers per level of a wavelet tree."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
            high = (values >> bit) & 1 == 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~high, out=zeros[1:])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~high], values[high]])

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers in each range [low, high) are below its bound."""
        low, high = low.copy(), high.copy()
        found = np.zeros(len(low), np.int64)
        top = self.levels[0][0] + 1 if self.levels else 0
        over = bound >> top > 0
        found[over] = (high - low)[over]
        for bit, zeros in self.levels:
            zl, zh = zeros[low], zeros[high]
            one = (bound >> bit) & 1 == 1
            found += np.where(one & ~over, zh - zl, 0)
            low = np.where(one, zeros[-1] + low - zl, zl)
            high = np.where(one, zeros[-1] + high - zh, zh)
        return found

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number (from 0) of each range."""
        low, high, k = low.copy(), high.copy(), k.copy()
        value = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            zl, zh = zeros[low], zeros[high]
            one = k >= zh - zl
            k -= np.where(one, zh - zl, 0)
            value |= np.where(one, 1 << bit, 0)
            low = np.where(one, zeros[-1] + low - zl, zl)
            high = np.where(one, zeros[-1] + high - zh, zh)
        return value

    def next(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest number of each range that is not below its bound, or NONE."""
        k = self.less(low, high, bound)
        out = np.full(len(low), NONE, np.int64)
        some = np.flatnonzero(k < high - low)
        out[some] = self.kth(low[some], high[some], k[some])
        return out


class Suffixes:
    """Suffix array of texts of one block of rows, and the names of all their dyadic blocks.

    ``keys`` are equal for equal words of one text and differ between texts. ``names[k]`` numbers, by the start of its range in the suffix
    array, the block of 2**k words at each position; names of blocks that would leave their text are not used.
    """

    def __init__(self, keys: np.ndarray, stop: np.ndarray):
        n = len(keys)
        self.stop = stop
        order, first = groups(keys)
        size = np.diff(np.r_[first, n])
        self.order = order.astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, size)
        self.names, self.shared = [rank.astype(np.int32)], [None]
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # slots of the array whose order is not settled
        step = 1
        while len(open_):
            at = self.order[open_]
            ahead = np.where(at + step < stop[at], rank[np.minimum(at + step, n - 1)], -1)
            sort = np.argsort(rank[at] * (n + 1) + ahead + 1, kind="stable")
            at, key = at[sort], (rank[at] * (n + 1) + ahead + 1)[sort]
            self.order[open_] = at  # a group keeps its slots, and groups stay in their order
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[new, len(key)])
            rank[at] = np.repeat(open_[new], size)
            several = np.repeat(size > 1, size)
            step *= 2
            self.names.append(rank.astype(np.int32))
            self.shared.append((at[several], np.repeat(size, size)[several]))  # blocks of ``step`` words that occur twice
            open_ = open_[several]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and j (i < j, of one text) on."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i + same, j + same
            fits = b + (1 << k) <= self.stop[j]
            b = np.where(fits, b, j)
            same += np.where(fits & (self.names[k][np.where(fits, a, i)] == self.names[k][b]), 1 << k, 0)
        return same

    def behind(self, i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words are equal before i and j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - same - (1 << k), j - same - (1 << k)
            fits = a >= start[i]
            a, b = np.where(fits, a, i), np.where(fits, b, j)
            same += np.where(fits & (self.names[k][a] == self.names[k][b]), 1 << k, 0)
        return same


def _candidates(suffixes: Suffixes, start: np.ndarray):
    """Positions and distances at which a block may show a period."""
    if len(suffixes.names) <= BLOCK.bit_length() - 1:
        return
    tree = RangeSuccessor(suffixes.order - start[suffixes.order])
    for level in range(BLOCK.bit_length() - 1, len(suffixes.names)):
        b = 1 << level
        at, size = suffixes.shared[level]
        keep = ((at - start[at]) % (b // 2) == 0) & (at + b <= suffixes.stop[at])
        at, size = at[keep], size[keep]
        low = suffixes.names[level][at].astype(np.int64)
        high = low + size
        i = at - start[at]
        nearest, farthest = (1, 10) if b == BLOCK else (3 * b // 2 - 1, 3 * b - 2)
        some = tree.next(low, high, i + nearest) <= i + farthest
        at, low, high, i = at[some], low[some], high[some], i[some]
        for d in range(nearest, farthest + 1, b // 2):  # occurrences within b/2 of each other: one progression
            last_place = i + d + b // 2 - 1
            first = tree.next(low, high, i + d)
            hit = np.flatnonzero(first <= last_place)
            p, lo, hi, here, end = at[hit], low[hit], high[hit], i[hit], last_place[hit]
            one = first[hit]
            two = tree.next(lo, hi, one + 1)
            single = two > end
            yield p[single], (one - here)[single]
            p, lo, hi, here, end, one, two = (x[~single] for x in (p, lo, hi, here, end, one, two))
            if not len(p):
                continue
            period = two - one
            last = tree.kth(lo, hi, tree.less(lo, hi, end + 1) - 1)
            yield p, period
            # members in the block's own stretch of that period have multiples of it as distances: no smallest periods
            reach = here + period + suffixes.ahead(p, p + period) - b
            inside = ((one - here) % period == 0) & (one <= reach)
            one = np.where(inside, one + ((reach - one) // period + 1) * period, one)
            count = np.maximum((last - one) // period + 1, 0)
            member = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield np.repeat(p, count), np.repeat(one - here, count) + member * np.repeat(period, count)


def find_runs(keys: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``keys``), length and period of every run, by start and then period.

    ``first`` holds the first word of each text and the end; equal words of one text have equal keys, words of two texts never.
    """
    counts = np.diff(first)
    start, stop = np.repeat(first[:-1], counts), np.repeat(first[1:], counts)
    suffixes = Suffixes(keys, stop)
    found = []
    for at, distance in _candidates(suffixes, start):
        if not len(at):
            continue
        after = suffixes.ahead(at, at + distance)
        before = suffixes.behind(at, at + distance, start)
        length = before + after + distance
        fits = length >= np.maximum(least, 2 * distance)
        found.append(np.unique(np.stack([(at - before)[fits], length[fits], distance[fits]]), axis=1))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    runs = np.unique(np.concatenate(found, axis=1), axis=1)
    smallest = np.r_[True, (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)][:runs.shape[1]]  # multiples of a period follow it
    at, length, period = runs[:, smallest]
    order = np.lexsort((period, at))
    return at[order], length[order], period[order]


def dropped(n: int, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at + period, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def joined(words: Words, chosen: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The chosen words (``counts`` of them per text) joined by single spaces, as a text column."""
    lengths = words.ends[chosen] - words.starts[chosen]
    width = lengths + 1  # each word and the space before it
    ends = np.cumsum(width)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    for lo in range(0, len(chosen), 100_000):  # byte positions of a part of the words at a time
        hi = min(lo + 100_000, len(chosen))
        size = lengths[lo:hi]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat((ends - lengths)[lo:hi], size) + inner] = words.data[np.repeat(words.starts[chosen[lo:hi]], size) + inner]
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
    keep = np.ones(len(out), bool)
    keep[bounds[:-1][counts > 0]] = False  # no space before the first word of a text
    offsets = bounds - np.r_[0, np.cumsum(counts > 0)]
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


def _listed(row: np.ndarray, n_rows: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def collapsed(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, rearranged=None) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (start, length and period, by start and period) and ``collapsed``, the words that
    no run holds behind its first period, joined by single spaces.

    A null or blank text has no words, no runs and an empty result. Equal rows are treated alike, an empty table
    gives no row, and other columns are left out. Words are compared by 64-bit hashes. ``rearranged(keep columns, words
    per text)`` may give, for the words of the texts one after the other, the word of the input that stands in each place. A
    text longer than a block is treated whole. Results replace kept columns of their names.
    """
    keep = tuple(c for c in keep if c not in ("n_words", "runs", "collapsed"))
    rows = docs.select(*(quoted(c).alias(f"kept_{i}") for i, c in enumerate(keep)), quoted(text).alias("text"))
    kept = [f.dataType.simpleString() for f in rows.schema.fields[:-1]]
    schema = ", ".join([*(f"kept_{i} {t}" for i, t in enumerate(kept)), "n_words bigint", f"runs {RUN_TYPE}", "collapsed string"])

    def each(batches):
        for block in blocks(batches):
            words = split(block.column(block.num_columns - 1), not_white())
            source = np.arange(len(words.row))
            if rearranged is not None:
                source = rearranged(block.columns[:-1], words.counts)
            h = hashes(words)[source]
            at, length, period = find_runs(mixed(h ^ mixed(words.row.astype(np.uint64))), words.first, least)
            gone = dropped(len(h), at, length, period)
            row = words.row[at] if len(at) else np.zeros(0, np.int64)
            lists = _listed(row, block.num_rows, at - words.first[row], length, period)
            counts = np.bincount(words.row[~gone], minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*block.columns[:-1], pa.array(words.counts, pa.int64()), lists, joined(words, source[~gone], counts)],
                [*(f"kept_{i}" for i in range(len(keep))), "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(each, schema)
    return out.select(*(quoted(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "n_words", "runs", "collapsed")


def planted(columns: list[pa.Array], counts: np.ndarray) -> np.ndarray:
    """A rearrangement that makes the texts of one id in ten periodic from some word on: with h the CRC-32 of the id in decimal and
    n words, word i >= a becomes word a + (i - a) % p, where a = g % n, p = 1 + (n - a) // (3 + g % 8) and g = h // 10.

    A null id leaves its text as it is.
    """
    first = np.r_[0, np.cumsum(counts)]
    source = np.arange(first[-1])
    for lo, n, doc_id in zip(first[:-1].tolist(), counts.tolist(), columns[0].to_pylist()):
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[lo + a:lo + n] = lo + a + np.arange(n - a) % p
    return source
