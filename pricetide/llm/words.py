"""Words, word hashes and rolling hashes of many texts at once.

A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return; ``bytes.split`` cuts exactly there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche (the splitmix64 finalizer)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        one = np.ones(1, np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = np.concatenate((one, np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))))
        _inverse = np.concatenate((one, np.multiply.accumulate(np.full(n - 1, inverse, np.uint64))))


class Texts:
    """The words of a list of texts in one row.  ``begin[i]:end[i]`` are those of text i."""

    def __init__(self, column: pa.Array, lower: bool = False, keep_words: bool = False):
        raw = column.cast(pa.binary()).to_pylist()
        words: list[bytes] = []
        counts = np.empty(len(raw), np.int64)
        for i, t in enumerate(raw):
            w = (t.lower() if lower else t).split() if t else []  # of bytes: A-Z only
            counts[i] = len(w)
            words += w
        self.counts, self.n = counts, len(words)
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, self.n)
        self.words = words if keep_words else None

    def prefix(self, seed: int | None = None) -> np.ndarray:
        """Prefix sums from which ``span`` takes the hash of any run of words; each seed gives other hashes."""
        _grow(self.n + 1)
        own = self.hashes if seed is None else mix(self.hashes, seed)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * _powers[: self.n], dtype=np.uint64)))

    @staticmethod
    def span(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a..b-1; equal for equal runs, wherever they stand."""
        return mix((prefix[b] - prefix[a]) * _inverse[a])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
