"""Words, shingles and their hashes, for whole batches of texts at once."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

#: Maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Hashes(dict):
    """xxh64 of each word; forgotten when there are many, so that a worker's memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of x touches every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(texts: Sequence[str], n: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): the hashed runs of n words of every text, one text after the other, and how many each has (0 with fewer than least_words words)."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower()) if t else []
        if len(w) < max(n, least_words):
            continue
        counts[i] = len(w)
        words.extend(w)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h, counts
    total = len(h) - n + 1
    s = np.zeros(max(total, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            s += h[k : k + total] * np.uint64(_MULTIPLIERS[k % 5]) + np.uint64(k)
        s = mixed(s)
    ends = np.cumsum(counts)
    inside = np.ones(len(s), bool)
    for k in range(1, n):  # runs that reach into the next text
        bad = ends[counts > 0] - k
        inside[bad[(bad >= 0) & (bad < len(s))]] = False
    return s[inside], np.where(counts > 0, counts - n + 1, 0)
