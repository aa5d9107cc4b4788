"""Word ids and Rabin-Karp hashes of fixed-length word windows, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: The base of the polynomial (odd) and the constants of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

REMEMBERED = 500_000


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_ids = _Ids()
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a worker hashes each word it meets once."""
    return np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(4096, 2 * n)
        grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
        _powers, _inverse = grow(BASE), grow(pow(BASE, -1, 1 << 64))
    return _powers[:n], _inverse[:n]


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words: prefix sums of the polynomial, shifted back to its start."""
    n = len(ids)
    if n < width:
        return np.empty(0, np.uint64)
    powers, inverse = _upto(n)
    sums = np.cumsum(ids * powers, dtype=np.uint64)
    spans = sums[width - 1 :].copy()
    spans[1:] -= sums[: n - width]
    return mixed(spans * inverse[: n - width + 1])


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, where each hash is among them, and how often each occurs."""
    return np.unique(hashes, return_inverse=True, return_counts=True)


class BlockWords:
    """The words of a block's documents in one array: ``ids``, and ``starts`` of each document and of the end."""

    def __init__(self, docs, keep: bool = False):
        self.docs, self.words, parts, sizes = [], [], [], [0]
        for doc, text in docs:
            words = text.split()
            self.docs.append(doc)
            parts.append(word_ids(words))
            sizes.append(len(words))
            if keep:
                self.words.append(words)
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.starts = np.cumsum(sizes)
        self.lengths = np.diff(self.starts)
        #: Of each word, its document's place in the block and its own place in the document.
        self.owner = np.repeat(np.arange(len(self.docs)), self.lengths)
        self.place = np.arange(len(self.ids)) - np.repeat(self.starts[:-1], self.lengths)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of ``width`` words that lie in one document."""
        left = np.repeat(self.starts[1:], self.lengths) - np.arange(len(self.ids))
        first = np.flatnonzero(left >= width)
        return first, window_hashes(self.ids, width)[first] if len(first) else np.empty(0, np.uint64)
