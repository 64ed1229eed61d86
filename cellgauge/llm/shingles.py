"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))


BYTE_CODES = stream(256, 7)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """Hashes of byte ranges of one buffer; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * _powers(BASE, n), out=self.sums[1:])
        self.back = _powers(BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (between ASCII white space, A-Z in lower case) of texts laid end to end in
    ``data``, where ``ends`` are the texts' ends; and the number of words of each text."""
    gap = np.ones(len(data) + len(ends) + 1, bool)
    # Each text is followed by a gap of its own, so no word spans two texts.
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    shifted = np.arange(len(data)) + text + 1
    gap[shifted] = _SPACE[data]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = turn[::2] + 1, turn[1::2] + 1
    flat = np.zeros(len(gap), np.uint8)
    flat[shifted] = _LOWER[data]
    hashes = RangeHash(flat)(start, end)
    borders = np.searchsorted(start, ends + np.arange(len(ends)) + 1)
    return hashes, np.diff(borders, prepend=0)


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text with fewer words than ``width`` is one shingle as
    a whole; one without words has none."""
    words, counts = word_hashes(data, ends)
    weights = stream(width, 11) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * weights[k]
    rolled = mix(rolled)
    sets, at = [], 0
    for c in counts.tolist():
        if c >= width:
            sets.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            whole = (words[at : at + c] * weights[:c]).sum(dtype=np.uint64) + np.uint64(c)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += c
    return sets
