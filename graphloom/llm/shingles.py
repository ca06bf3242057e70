"""Word shingles as hashed sets, vectorised per text."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[bytes, int] = {}
_MAX_WORDS = 150_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def split(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes split at the blank and tab .. carriage return only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; the whole sequence when it is shorter; empty without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_words) > _MAX_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(width, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = out * _PRIME + h[k : n - size + 1 + k]
    out = (out ^ (out >> np.uint64(29))) * _MIX + np.uint64(size)
    return np.unique(out ^ (out >> np.uint64(32)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
