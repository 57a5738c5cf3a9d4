"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of bytes other than space and 0x09-0x0D. All arithmetic on hashes is modulo 2^64.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# A random number for each byte value, and the multiplier of the polynomial.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of BASE and of its inverse; as many as the next power of two and one are kept."""
    global _powers
    if _powers.shape[1] < n:
        made = np.ones((2, (1 << max(n - 2, (1 << 18) - 1).bit_length()) + 1), np.uint64)
        made[:, 1:] = [[BASE], [INVERSE]]
        _powers = np.cumprod(made, axis=1, dtype=np.uint64, out=made)
    return _powers[:, :n]


LONG = 32  # bytes of a stretch from which on a polynomial does not decide equality


class Rolling:
    """Hashes of any stretches of ``data``; equal bytes give equal hashes wherever they stand.

    A polynomial modulo 2^64 tells short stretches apart, but for long ones with a regular build (as of a word and the
    same with two letters exchanged, doubled again and again) its lower bits are all zero, whatever the base is.
    Where equality of stretches of any length is decided, ``unlike`` has to be used.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * ODD)

    def unlike(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As ``of``, with 64 bits of a cryptographic digest for stretches of more than LONG bytes."""
        hashes = self.of(start, end)
        for k in np.flatnonzero(end - start > LONG).tolist():
            digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest()
            hashes[k] = int.from_bytes(digest, "little")
        return hashes

    def fixed(self, width: int) -> np.ndarray:
        """Of every stretch of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (one entry more than texts)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.ones(len(data) + 1, bool)
    before[1:] = ~solid
    begin = np.flatnonzero(solid & (before[:-1] | edge[:-1]))
    after = np.ones(len(data) + 1, bool)
    after[:-1] = ~solid
    end = np.flatnonzero(solid & (after[1:] | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the index of each text's first word."""
    begin, end, first = spans(data, at)
    return Rolling(data).unlike(data, begin, end), first


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text (A-Z in lower case), sorted, and where each text's begin (one entry more than texts).

    A text with fewer than ``width`` words has its whole sequence as the only shingle, one without words none.
    """
    word, first = word_hashes(LOWER[data], at)
    count = np.diff(first)
    long = np.maximum(count - width + 1, 0)
    size = np.where(count >= width, long, (count > 0).astype(np.int64))
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    text = np.repeat(np.arange(len(size)), size)
    place = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    made = np.zeros(len(place), np.uint64)
    last = first[1:][text]
    for k in range(width):
        there = place + k < last
        factor = np.uint64(int(ODD) * (2 * k + 1) % (1 << 64))
        made[there] = mix(made[there] + word[place[there] + k] * factor + np.uint64(k + 1))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > 1:
            made[a:b].sort()
    fresh = np.ones(len(made), bool)
    fresh[1:] = made[1:] != made[:-1]
    fresh[begin[:-1][size > 0]] = True
    kept = np.zeros(len(made) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return made[fresh], kept[begin]
