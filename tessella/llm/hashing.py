"""Vectorised Rabin-Karp hashes of words and of runs of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that are hashed at once; the tables of powers are this long.
_SEGMENT = 1 << 19

@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads a hash over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end]."""
    size = max(1 << (max(len(values), 1) - 1).bit_length(), 1 << 12)
    power, inverse = _powers(base, size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of a byte array, whatever its place, where it starts and where it ends; long arrays are cut at white space."""
    out, begin, finish, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = min(at + _SEGMENT, len(text))
        while end < len(text) and not _SPACE[text[end - 1]]:
            step = np.flatnonzero(_SPACE[text[end : end + _SEGMENT]])
            end = end + int(step[0]) + 1 if len(step) else min(end + _SEGMENT, len(text))
        part = text[at:end]
        solid = np.zeros(len(part) + 2, np.int8)
        solid[1:-1] = ~_SPACE[part]
        turn = np.diff(solid)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        hashes = rolling(part.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE)
        out.append(mixed(hashes + (ends - starts).astype(np.uint64)))
        begin.append(starts + at)
        finish.append(ends + at)
        at = end
    return np.concatenate(out), np.concatenate(begin), np.concatenate(finish)
