"""Byte-level text kernels shared by the Python-side operators.

Words are runs of bytes other than 0x20 and 0x09-0x0D; lower-casing touches
A-Z alone.  ``bytes.lower`` and ``bytes.split`` have exactly these rules.
All hashes are 64-bit xxh3 digests of the word bytes, so they agree between
workers, attempts and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
U64 = np.uint64


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes (None for null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash for each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=U64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A cheap bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * MIX
    return x ^ (x >> U64(27))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order (empty if too short)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= MULT
        out += hashes[i : i + n]
    return mix64(out)


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; shorter texts form one shingle."""
    if not words:
        return np.zeros(0, U64)
    hashes = word_hashes(words)
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
