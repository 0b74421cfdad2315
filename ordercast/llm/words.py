"""Words of a text and 64-bit hashes of words and of windows of words.

Words are maximal runs of characters other than space and the five control characters from tab to
carriage return; in UTF-8 these are exactly the parts that splitting bytes at ASCII blanks gives.
Hashes of different words, or windows, are taken to differ (64 bits).
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from ordercast.llm.common import REMEMBERED, remembered

_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio, odd
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


_known = remembered(_Hashes())


def words(text: str, fold: bool = True) -> list[bytes]:
    """The words in UTF-8; with ``fold``, A-Z in lower case."""
    data = text.encode("utf-8", "replace")
    return (data.lower() if fold else data).split()


def hashes(found: list[bytes]) -> np.ndarray:
    """One hash per word."""
    if len(_known) > REMEMBERED:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words, in order; none if there are fewer words."""
    if len(h) < width:
        return h[:0]
    n = len(h) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out * _ODD + h[k : k + n])
    return out


def join(*columns: np.ndarray) -> np.ndarray:
    """The hashes of windows whose words stand in ``columns``."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        out = mix(out * _ODD + column)
    return out


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct window hashes; a shorter text is one window; no words, no window."""
    if 0 < len(h) < width:
        return windows(np.concatenate([h, np.full(1, len(h), dtype=np.uint64)]), len(h) + 1)
    return np.unique(windows(h, width))
