"""Elias-Fano sequences over numpy arrays, and packs of arrays in one file.

A monotone sequence of ``n`` values below ``u`` keeps ``log2(u / n)`` low bits
of each packed side by side and the high parts in unary, about two bits each.
One count for each 64-bit word of the unary part serves both selects.  All
queries are vectorised and read only the words they need, so a pack that is
memory-mapped is never loaded whole.
"""

from __future__ import annotations

import json

import numpy as np

from .storage import mapped, put_file

U64 = np.uint64
_ALL = U64(0xFFFFFFFFFFFFFFFF)


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.int64)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word, by halving."""
    at, k, words = np.zeros(len(words), np.int64), k.copy(), words.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = words & U64((1 << half) - 1)
        n = _popcount(low)
        up = k >= n
        k -= np.where(up, n, 0)
        at += np.where(up, half, 0)
        words = np.where(up, words >> U64(half), low)
    return at


class EliasFano:
    """A readable sequence; ``encode`` gives the arrays it is made from."""

    def __init__(self, size: int, low_bits: int, low, high, ones):
        self.size, self.bits = int(size), int(low_bits)
        self.low, self.high, self.ones = low, high, ones

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros(((top >> bits) + n) // 64 + 2, U64)
        if n:
            at = (values >> U64(bits)).astype(np.int64) + np.arange(n)
            np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
        low = np.zeros(n * bits // 64 + 2, U64)
        if n and bits:
            part = values & U64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(_popcount(high))]).astype(np.int64)
        return {"shape": np.array([n, bits], np.int64), "low": low, "high": high, "ones": ones}

    @classmethod
    def open(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.shape"].tolist()
        return cls(n, bits, *(arrays[f"{name}.{part}"] for part in ("low", "high", "ones")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        first = self.low[word] >> shift
        over = (at & 63) + self.bits > 64
        second = np.where(over, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (first | second) & U64((1 << self.bits) - 1)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        return (word << 6) + _select_in_word(self.high[word], i - self.ones[word])

    def _select0(self, i: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(zeros, i, side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        return (word << 6) + _select_in_word(self.high[word] ^ _ALL, i - zeros[word])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U64)
        return ((self._select1(i) - i).astype(U64) << U64(self.bits)) | self._low(i)

    def successors(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is at least ``x`` (size if none)."""
        x = np.asarray(x, U64)
        if not self.size or not len(x):
            return np.full(len(x), self.size, np.int64)
        part = (x >> U64(self.bits)).astype(np.int64)
        limit = int(self.high.shape[0]) * 64 - self.size
        inside = part < limit
        part = np.where(inside, part, 0)
        start = np.where(part > 0, self._select0(np.maximum(part - 1, 0)) + 1 - part, 0)
        stop = self._select0(part) - part
        want = x & U64((1 << self.bits) - 1)
        lo, hi = start.copy(), stop.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return np.where(inside, np.minimum(lo, self.size), self.size)


def flat(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays of one sequence under its name."""
    return {f"{name}.{k}": v for k, v in arrays.items()}


def write_pack(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file: a JSON header, then the arrays on 8-byte bounds."""
    at, header = 0, {}
    for name, array in arrays.items():
        header[name] = [array.dtype.str, at, len(array)]
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(header).encode()
    head += b" " * (-len(head) % 8)

    def chunks():
        yield len(head).to_bytes(8, "little") + head
        for array in arrays.values():
            yield array.tobytes() + b"\0" * (-array.nbytes % 8)

    put_file(uri, chunks())


def open_pack(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a pack as views of the mapped file."""
    raw = mapped(uri, np.uint8)
    size = int.from_bytes(bytes(raw[:8]), "little")
    header = json.loads(bytes(raw[8 : 8 + size]))
    body = raw[8 + size :]
    return {
        name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in header.items()
    }
