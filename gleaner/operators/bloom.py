"""A Bloom filter of word n-grams, in front of an exchange: grams that no name has are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each gram, and for a whole filter (32 MB); a fuller filter lets more pass and never loses a gram.
BITS, MOST_BITS = 16, 28
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place of an array of word hashes."""
    size = max(len(words) - n + 1, 0)
    return _mixed([words[j : j + size] for j in range(n)], size)


def _mixed(columns: Sequence[np.ndarray], size: int) -> np.ndarray:
    out = np.full(size, len(columns), np.uint64)
    for column in columns:
        out = (out ^ column) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(64 - bits)).astype(np.int64)


def filter_of(grams: DataFrame) -> np.ndarray:
    """The packed bits of ``grams(hashes)``, each an array of the gram's word hashes; tasks send each word of bits once."""
    bits = min(MOST_BITS, max(16, (BITS * grams.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            words = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.asarray(batch.column(0).value_lengths(), np.int64)
            begin = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                first = begin[size == n]
                for at in _places(_mixed([words[first + j] for j in range(n)], len(first)), bits):
                    np.bitwise_or.at(flags, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(flags)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flags[some].view(np.int64))], ["w", "m"])

    told = grams.select("hashes").mapInArrow(run, "w long, m long").groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toArrow()
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return packed.view(np.uint64)


def may_have(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = (64 * len(packed)).bit_length() - 1
    out = np.ones(len(h), bool)
    for at in _places(h, bits):
        out &= (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def likely_grams(texts: DataFrame, sizes: Sequence[int], packed: np.ndarray) -> DataFrame:
    """``h, n, gram``: the distinct grams of ``texts(h, w, hashes)`` with the given numbers of words that the filter lets pass."""
    shared = texts.sparkSession.sparkContext.broadcast(packed)
    kind = texts.schema["h"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes = batch.column(1).flatten(), batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            count = np.asarray(batch.column(1).value_lengths().fill_null(0), np.int64)
            row = np.repeat(np.arange(len(count)), count)
            left = np.repeat(np.cumsum(count), count) - np.arange(len(row))
            for n in sizes:
                h = gram_hashes(hashes, n)
                at = np.flatnonzero(may_have(shared.value, h) & (left[: len(h)] >= n))
                if not len(at):
                    continue
                at = at[np.lexsort((h[at], row[at]))]
                at = at[np.r_[True, (row[at[1:]] != row[at[:-1]]) | (h[at[1:]] != h[at[:-1]])]]
                grams = pc.binary_join_element_wise(*[words.take(pa.array(at + j)) for j in range(n)], pa.scalar(" ", words.type)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(np.full(len(at), n, np.int32)), grams], ["h", "n", "gram"])

    return texts.select("h", "w", "hashes").mapInArrow(run, f"h {kind}, n int, gram string")
