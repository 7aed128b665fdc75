"""Words, word hashes and shingles of Arrow text columns, in numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

#: Words split by ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = "spaced"
#: Words of ASCII letters, digits and all beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = "alnum"

_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Words that are remembered, and bytes of the longest of them.
_CACHE_WORDS, _CACHE_BYTES = 300_000, 64


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def split(text: bytes | None, kind: str = SPACED) -> list[bytes]:
    """Words of a text with A-Z in lower case; a null or blank text has none."""
    if not text:
        return []
    return text.lower().split() if kind == SPACED else text.translate(_ALNUM).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        if len(word) <= _CACHE_BYTES:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()
#: What a worker remembers from task to task; other modules add theirs.
memos: list[dict] = [_hashes]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def trim() -> None:
    """Hand freed memory back."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def release() -> None:
    """Empty the memos and hand freed memory back, as a worker goes on to tasks of other stages."""
    for memo in memos:
        memo.clear()
    trim()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; a memo of bounded size keeps the frequent words."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a sum of products so that each bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingles(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    m = min(n, len(h))
    total = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        total += h[k : len(h) - m + 1 + k] * (_ODD[k % 8] + np.uint64(2 * (k // 8)))
    return np.unique(mix(total))
