"""Near-duplicate documents by HyperMinHash.

A document is the set of its five-word shingles. Every shingle falls into one of a number of
buckets and the smallest hash in a bucket is kept as a register: the number of its leading
zeros and the bits that follow them. Buckets that get nothing in one round of hashing are filled by the
next, so that registers of two documents agree as often as their sets do, however small.
Bands of registers pick candidates, the share of equal registers, less what agrees by chance,
estimates their likeness, and pairs that may be alike are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np

from ledgerflow.llm import chunks as c

REGISTERS = 192
BAND = 4
ZERO_BITS, MANTISSA_BITS = 6, 10
SHINGLE = 5
_SEED = np.uint64(0xA0761D6478BD642F)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of every ``size`` neighbouring words, given as hashes; fewer words
    make one shingle, none make none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < size:
        whole = np.uint64(len(words))
        for w in words:
            whole = c.mix(np.array([whole * np.uint64(c.FACTOR) + w], dtype=np.uint64))[0]
        return np.array([whole], dtype=np.uint64)
    return np.unique(c.mix(c.rolling(words, size, c.FACTOR)))


def registers(shingles: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """uint16 registers of a set that is not empty: leading zeros, then the bits behind them."""
    least = np.full(count, ~np.uint64(0), dtype=np.uint64)
    empty, round_ = np.ones(count, dtype=bool), 0
    while empty.any():
        rounds = max(1, min(512, 2 * count // len(shingles)))
        seeds = (np.arange(round_, round_ + rounds, dtype=np.uint64) + np.uint64(1)) * _SEED
        hashed = c.mix(shingles[None, :] ^ c.mix(seeds)[:, None])
        for row in hashed:
            bucket = (row % np.uint64(count)).astype(np.int64)
            value = c.mix(row)
            new = np.full(count, ~np.uint64(0), dtype=np.uint64)
            np.minimum.at(new, bucket, value)
            got = np.zeros(count, dtype=bool)
            got[bucket] = True
            fill = empty & got
            least[fill] = new[fill]
            empty &= ~got
            if not empty.any():
                break
        round_ += rounds
    return compress(least)


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 63) in the high bits, the next MANTISSA_BITS bits in the low ones."""
    top = np.zeros(len(values), dtype=np.int64)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = rest < (np.uint64(1) << np.uint64(64 - step))
        top += np.where(small, step, 0)
        rest = np.where(small, rest << np.uint64(step), rest)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    return (np.minimum(top, 63) << MANTISSA_BITS).astype(np.uint16) | mantissa.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness from rows of registers: the share of equal ones, corrected for registers of
    different hashes that agree by chance once they are compressed."""
    equal = (a == b).mean(axis=1)
    chance = 2.0**-MANTISSA_BITS / 3  # leading zeros agree for a third of unlike hashes
    return np.maximum(0.0, (equal - chance) / (1 - chance))
