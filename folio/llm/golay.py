"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

Every 23-bit word is within 3 bits of exactly one of the 4096 codewords. The keys
of a word are the codewords that it and its 23 one-bit neighbours decode to: one
key or six. Words that differ in at most 2 bits have a word within 1 bit of both,
so they share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0xC75
BITS = 23


def remainder(word: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error for each syndrome."""
    bit = [remainder(1 << i) for i in range(BITS)]
    low, high = np.zeros(4096, np.uint16), np.zeros(2048, np.uint16)
    for i in range(12):
        low[np.arange(4096) >> i & 1 == 1] ^= bit[i]
    for i in range(11):
        high[np.arange(2048) >> i & 1 == 1] ^= bit[12 + i]
    error = np.zeros(2048, np.uint32)
    for n in (1, 2, 3):
        for flips in combinations(range(BITS), n):
            error[np.bitwise_xor.reduce([bit[i] for i in flips])] = sum(1 << i for i in flips)
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices for each word and which of the six are in use."""
    words = words.astype(np.uint32)
    flips = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.uint32)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    slot = np.cumsum(new, axis=1) - 1
    out, used = np.zeros((len(words), 6), np.uint64), np.zeros((len(words), 6), bool)
    row = np.nonzero(new)[0]
    out[row, slot[new]] = found[new]
    used[row, slot[new]] = True
    return out, used
