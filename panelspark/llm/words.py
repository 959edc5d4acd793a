"""Words of Arrow text columns as NumPy arrays: where they lie, 64-bit hashes of words and of windows of words.

All steps work on UTF-8 bytes. A class of word characters is a table of 256 flags; bytes of 0x80 and above belong
to words in every class here, so no character is ever cut. Hashes are polynomials over the bytes modulo 2**64 with
a finishing mix, taken for all words of a block at once from running sums.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of one block of rows; memory per block is a small multiple of it, plus that of the longest single text.
BLOCK_BYTES = 2 << 20
#: Bytes whose running sums are held at a time; a worker keeps two tables of eight times as many bytes.
SLICE_BYTES = 1 << 17

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_WINDOW_STEP = np.uint64(0xD1342543DE82EF95)


def not_white() -> np.ndarray:
    """Flags of the bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    flags = np.ones(256, bool)
    flags[[0x20, *range(0x09, 0x0E)]] = False
    return flags


def alphanumeric() -> np.ndarray:
    """Flags of the bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; upper-case letters are to be lowered before."""
    flags = np.zeros(256, bool)
    flags[0x30:0x3A] = flags[0x61:0x7B] = flags[0x80:] = True
    return flags


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lowered, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    if not column.buffers()[2]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and what they once held counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(None)


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of record batches whose texts have about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


@dataclass
class Words:
    """Words of the rows of a block: byte bounds, the row of each, the first word and first byte of each row (plus the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def place(self) -> np.ndarray:
        """Index of each word within its row."""
        return np.arange(len(self.row)) - self.first[self.row]

    def row_bytes(self, i: int) -> bytes:
        lo, hi = self.first[i], self.first[i + 1]
        return self.data[self.starts[lo]:self.ends[hi - 1]].tobytes() if hi > lo else b""


def split(column: pa.Array, flags: np.ndarray, lower: bool = False) -> Words:
    data, offsets = column_bytes(column)
    data = lowered(data) if lower else data
    n_rows = len(offsets) - 1
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = flags[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[offsets[:-1]] = inside[offsets[:-1]]  # rows touch each other without a break
    finish = np.zeros(len(data) + 1, bool)
    finish[1:] = inside[:-1] & ~inside[1:]
    finish[offsets[1:]] |= inside[np.maximum(offsets[1:] - 1, 0)] & (offsets[1:] > 0)
    finish[0] = False
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish)
    first = np.searchsorted(starts, offsets).astype(np.int64)
    return Words(data, starts, ends, np.repeat(np.arange(n_rows), np.diff(first)), first, offsets)


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def hashes(words: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word; ``seed`` names one of many independent functions."""
    rng = np.random.Generator(np.random.PCG64(seed))
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = (_STEP + 2 * seed * 0x51ED270B) % (1 << 64)
    back = pow(base, -1, 1 << 64)
    out = np.empty(len(words.starts), np.uint64)
    lo = 0
    while lo < len(out):
        at = int(words.starts[lo])
        hi = max(lo + 1, int(np.searchsorted(words.ends, at + SLICE_BYTES, "right")))
        end = int(words.ends[hi - 1])
        if end - at > 4 * SLICE_BYTES:  # one very long word
            out[lo] = _long_hash(words.data[at:end], values, base)
        else:
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(values[words.data[at:end]] * _power_table(base, end - at), out=sums[1:])
            s = words.starts[lo:hi] - at
            out[lo:hi] = (sums[words.ends[lo:hi] - at] - sums[s]) * _power_table(back, end - at)[s]
        lo = hi
    return mixed(out)


def _long_hash(data, values, base) -> np.uint64:
    total, scale, step = np.uint64(0), 1, pow(base, SLICE_BYTES, 1 << 64)
    for i in range(0, len(data), SLICE_BYTES):
        part = values[data[i:i + SLICE_BYTES]] * _power_table(base, min(SLICE_BYTES, len(data) - i))
        total = np.uint64((int(total) + int(part.sum(dtype=np.uint64)) * scale) % (1 << 64))
        scale = scale * step % (1 << 64)
    return total


def windows(word_hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``size`` words that lies in one row."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _WINDOW_STEP + word_hashes[j:j + n]
    at = np.flatnonzero(row[:n] == row[size - 1:])
    return at, mixed(total[at])


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys and the start of each run of equal keys in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)


def contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys
