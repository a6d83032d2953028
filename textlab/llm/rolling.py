"""Polynomial hashes of byte windows and of words, modulo 2**64, by prefix sums."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a text whose words are hashed at once.
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def prefix(b: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE ** place before each place; len(b) + 1 of them."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to stop, the same wherever they stand."""
    return (sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start]


def windows_at(b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return between(prefix(b), at, at + width)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of the hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every word; the six ASCII spaces split."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def as_words(data: bytes) -> np.ndarray:
    """A hash of every word."""
    start, stop = word_spans(data)
    out = np.zeros(len(start), np.uint64)
    b = np.frombuffer(data, np.uint8)
    k = 0
    while k < len(start):
        if stop[k] - start[k] > BLOCK // 2:
            out[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]])
            k += 1
            continue
        n = max(1, int(np.searchsorted(stop, start[k] + BLOCK, "right")) - k)  # words up to the block's end
        if long := np.flatnonzero(stop[k : k + n] - start[k : k + n] > BLOCK // 2).tolist():
            n = long[0]
        at = slice(k, k + n)
        sums = prefix(b[start[k] : stop[k + n - 1]])
        out[at] = mixed(between(sums, start[at] - start[k], stop[at] - start[k]) + (stop[at] - start[at]).astype(np.uint64))
        k += n
    return out
