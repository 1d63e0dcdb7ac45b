"""Words and hashed word sequences, in batches (numpy).

A word is a maximal run of Unicode letters and digits, in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hash of each word, computed once per distinct word.

    The cache is dropped at ``limit`` words, so it stays bounded over any corpus.
    """

    limit = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashed_words(texts: Iterable[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and the offsets of each text (one more than texts)."""
    get, parts, lens = cache.__getitem__, [], [0]
    for t in texts:
        found = words(t)
        lens.append(len(found))
        parts.append(np.fromiter(map(get, found), np.uint64, len(found)))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.cumsum(np.array(lens, np.int64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _S32)) * _MIX
    h = (h ^ (h >> _S29)) * _MIX2
    return h ^ (h >> _S32)


def shingles(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last ``k - 1`` positions are missing."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h + flat[i : i + n])
    return h


def inside(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For shingles of concatenated texts: the positions that lie within one text, and each one's text."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return np.arange(len(doc)) - first[doc] + offsets[:-1][doc], doc
