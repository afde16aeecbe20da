"""Word shingles of whole texts as 64-bit hashes.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A text's set holds the hashes of its distinct
runs of ``k`` words; a text with fewer words has its whole sequence as its only run, one without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker keeps; a bound on memory only.
KEPT_WORDS = 200_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    global _kept_powers
    if len(_kept_powers[0]) < n:
        size, one = 1 << max(10, (n - 1).bit_length()), np.ones(1, dtype=np.uint64)
        steps = (np.full(size - 1, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        _kept_powers = tuple(np.concatenate([one, np.multiply.accumulate(x)]) for x in steps)
    return tuple(x[:n] for x in _kept_powers)


_kept_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, dtype=np.uint64),) * 2


class Runs:
    """Running Karp-Rabin: prefix sums modulo 2^64, from which runs of any length are hashed without their words."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = _powers(len(words))
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up, dtype=np.uint64, out=self.sums[1:])

    def of(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` words, in order; a shorter text is one run."""
        n = min(k, len(self.down))
        if not n:
            return np.zeros(0, dtype=np.uint64)
        total = (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.down) - n + 1]
        return mixed(total + np.uint64(n))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; a shorter text is one run."""
    return Runs(words).of(k)


def shingles(text: bytes, k: int) -> np.ndarray:
    """The text's set, in ascending order."""
    return np.unique(runs(word_hashes(text), k))
