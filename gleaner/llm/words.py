"""Words of whole texts as 64-bit hashes, many documents at a time, for the operators that run in numpy.

Texts are cut into byte words with C-level ``bytes`` methods; hashes come from a bounded per-worker cache.
All documents of a slice lie in one array with their bounds, so n-gram hashes and sliding minima are a few
vector operations for the slice, however many documents it has.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
NONE = U64(0xFFFFFFFFFFFFFFFF)
SLICE_BYTES = 2 << 20
#: A-Z lower, ASCII other than letters and digits to a blank, other bytes as they are.
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_space_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()


class _Hashes(dict):
    """Word to hash, emptied when it is full, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def make_room() -> None:
    """Drop the token cache that a packing task may have left in this worker."""
    tokens = sys.modules.get("gleaner.llm.tokens")
    if tokens is not None and tokens.encoder.cache_info().currsize:
        tokens.encoder.cache_clear()
        gc.collect()


def free() -> None:
    """Empty the word cache and hand free memory back to the system."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def hashed(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place of the array; ``len(h) - n + 1`` of them."""
    if len(h) < n:
        return np.empty(0, U64)
    size = len(h) - n + 1
    acc = h[:size].copy()
    for j in range(1, n):
        acc = acc * BASE + h[j : j + size]
    return mix(acc ^ U64(n))


class Bag:
    """The word hashes ``h`` of several documents; document ``i`` has ``h[at[i]:at[i + 1]]``."""

    def __init__(self, docs: Sequence[Sequence[bytes]]):
        self.n = np.fromiter(map(len, docs), np.int64, len(docs))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.h = hashed([w for d in docs for w in d])
        self.doc = np.repeat(np.arange(len(docs)), self.n)

    def left(self) -> np.ndarray:
        """How many words of its document follow from each place, itself included."""
        return self.at[self.doc + 1] - np.arange(len(self.h))


def slices(texts: Sequence[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each; a longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def covered(n: int, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Flags of ``n`` places that lie in any of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` consecutive values, the last of equal ones."""
    val, idx, have = h, np.arange(len(h)), 1
    out_v, out_i, done = None, None, 0
    left = width
    while left:
        if left & 1:
            if out_v is None:
                out_v, out_i, done = val, idx, have
            else:
                a_v, a_i, b_v, b_i = out_v, out_i, val[done:], idx[done:]
                size = min(len(a_v), len(b_v))
                right = b_v[:size] <= a_v[:size]
                out_v, out_i = np.where(right, b_v[:size], a_v[:size]), np.where(right, b_i[:size], a_i[:size])
                done += have
        left >>= 1
        if left:
            size = max(len(val) - have, 0)
            right = val[have : have + size] <= val[:size]
            val, idx, have = np.where(right, val[have : have + size], val[:size]), np.where(right, idx[have : have + size], idx[:size]), 2 * have
    return out_i[: max(len(h) - width + 1, 0)]
