"""The perfect binary Golay code of length 23: every word is within three bits of exactly one of 4,096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of each message; message bits of the errors of weight up to 3, and of weight 4, by syndrome (-1: none)."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    of_bit = [remainder(1 << bit) for bit in range(23)]
    checks = np.zeros(4096, np.int64)
    for bit in range(12):
        checks[1 << bit:2 << bit] = checks[:1 << bit] ^ of_bit[11 + bit]
    nearest, further = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = syndrome = 0
            for bit in bits:
                error, syndrome = error | 1 << bit, syndrome ^ of_bit[bit]
            if weight < 4:
                nearest[syndrome] = error >> 11
            else:
                further[syndrome].append(error >> 11)
    return checks, nearest, np.array([f or [-1] * 5 for f in further])


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Messages of the codewords within four bits of each word: one, or six if the nearest is three bits off (-1: none).

    Two words that differ in at most two bits have a codeword in common here: between them lies a word at most one
    bit from both, whose own codeword is within three bits of it.
    """
    checks, nearest, further = _tables()
    message = words >> 11
    syndrome = checks[message] ^ (words & 2047)
    more = further[syndrome]
    return np.column_stack([message ^ nearest[syndrome], np.where(more < 0, -1, message[:, None] ^ more)])
