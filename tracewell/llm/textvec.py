"""Vectorised word access over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit polynomials taken from prefix sums, so the hash of
any word, or of any run of words, costs two look-ups.  Everything works on slices of a few hundred
kilobytes; a longer text is a slice of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = int(_RNG.integers(1, 2**62)) * 8 + 5
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche the bits of each hash."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base % 2**64, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def run_prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which run_hash() takes the hash of any run of values."""
    up, _ = _power(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end), wherever the run stands."""
    _, down = _power(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


@dataclass
class Slice:
    """Some rows of a text column: bytes, row offsets, and the words in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def find_words(self) -> None:
        space = _SPACE[self.data]
        n = len(space)
        word = ~space
        first, last = word.copy(), word.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.rows)
        self.first = np.zeros(self.rows + 1, np.int64)
        np.cumsum(self.n_words, out=self.first[1:])

    def byte_prefix(self, lower: bool = False) -> np.ndarray:
        return run_prefix((_BYTE_LOWER if lower else _BYTE)[self.data])

    def hash_words(self, lower: bool = False) -> np.ndarray:
        return run_hash(self.byte_prefix(lower), self.start, self.end)


def text_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """Slices of a text column without nulls, each of one row or at most max_bytes."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
