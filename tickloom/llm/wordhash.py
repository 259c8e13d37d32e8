"""Words of a batch of texts as numpy arrays: positions and 64-bit hashes, without a loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import LOWER

_LOWER = np.frombuffer(LOWER, dtype=np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; tables grow by doubling."""
    return _powers(base, max(1 << 18, 1 << max(n - 1, 1).bit_length()))[:n]


def _spans(values: np.ndarray, first: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[first:stop] for many ranges, by prefix sums."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return (sums[stop] - sums[first]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[first]


def words(text: bytes | np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and hash (never 0) of every word: runs of bytes but space and \\x09-\\x0D, A-Z lower-cased."""
    data = np.frombuffer(text, dtype=np.uint8) if isinstance(text, bytes) else text
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes, at = np.empty(len(first), dtype=np.uint64), 0
    while at < len(first):  # blocks of whole words
        to = max(at + 1, int(np.searchsorted(stop, first[at] + block, side="right")))
        low, high = first[at], stop[to - 1]
        part = _LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)
        hashes[at:to] = mix(_spans(part, first[at:to] - low, stop[at:to] - low, _BYTE) + (stop[at:to] - first[at:to]).astype(np.uint64))
        at = to
    return first, stop, np.maximum(hashes, np.uint64(1))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position in ``first``."""
    return mix(_spans(hashes, first, first + n, _WORD))


def spans(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of word ranges of any length."""
    return mix(_spans(hashes, first, stop, _WORD))


def sliding(op, values: np.ndarray, n: int) -> np.ndarray:
    """op (np.minimum, np.maximum) over every n consecutive values, in log n steps."""
    width = 1
    while 2 * width <= n:
        values = op(values[: len(values) - width], values[width:])
        width *= 2
    rest = n - width
    return op(values[: len(values) - rest], values[rest:]) if rest else values
