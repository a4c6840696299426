"""Words and word shingles of texts as 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """Hashes of words, made when missed; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = _WordHashes()


def word_hashes(text: str, limit: int = 500_000) -> np.ndarray:
    """Hashes of the words of ``text``, in lower case and split at ASCII blanks."""
    if len(_hashes) > limit:
        _hashes.clear()
    words = text.lower().encode().split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each 64-bit value."""
    out = (values ^ np.uint64((seed * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64)) * _MIX
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of the ``width`` words from each place on; one hash of all if there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        out = out * _STEP + words[i : i + count]
    return mixed(out)
