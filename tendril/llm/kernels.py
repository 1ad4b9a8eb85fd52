"""Array kernels shared by the text operators of this subpackage.

Every kernel works on one Arrow string column at a time, in slices of a few
megabytes, and hashes whole slices with prefix sums instead of looping over
words.  They are plain helpers for ``mapInArrow`` functions: Spark deals the
rows and moves the results, nothing here holds more than one slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that a kernel expands at a time; a longer text is a slice of its own.
SLICE_BYTES = 512 << 10

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = int(_rng.integers(2**40, 2**62)) * 2 + 1
_P_INV = pow(_P, -1, 2**64)
_STEP = 1 << 16


def give_back() -> None:
    """Freed memory goes back to the system: a worker process lives on and serves other operators."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h = h * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags: True for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words are runs of anything but space and the ASCII controls 9-13.
SPACED = byte_class([(0x09, 0x0D), (0x20, 0x20)])
#: Words are runs of ASCII digits and lower-case letters and of all non-ASCII characters.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: ASCII lower-casing, leaving other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of consecutive documents: spans in ``data``, and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more entry than documents

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial over random byte values, then mixed."""
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        return mix(span_hash(self.data, self.start, self.end))


_POW = _powers(_P, SLICE_BYTES + 1)
_INV = _powers(_P_INV, SLICE_BYTES + 1)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans ascend and do not overlap.  Long data is taken in stretches."""
    if len(data) <= SLICE_BYTES:
        return _span_hash(data, start, end, _POW, _INV)
    out = np.empty(len(start), dtype=U64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + SLICE_BYTES, side="right")))
        size = int(end[j - 1] - base)
        powers = (_POW, _INV) if size <= SLICE_BYTES else (_powers(_P, size + 1), _powers(_P_INV, size + 1))  # one word longer than a stretch
        out[i:j] = _span_hash(data[base : end[j - 1]], start[i:j] - base, end[i:j] - base, *powers)
        i = j
    return out


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, pow_: np.ndarray, inv: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, dtype=U64)
        total[0] = 0
        term = _BYTE[data]
        term *= pow_[: len(data)]
        np.cumsum(term, out=total[1:])
        return (total[end] - total[start]) * inv[start]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string column; null is empty."""
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_, at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts have ``most`` bytes together, or one document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    give_back()


def words(bytes_: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    """The words of the documents whose offsets are ``at``."""
    data = bytes_[at[0] : at[-1]]
    if lower:
        data = LOWER[data]
    inside = table[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[(at - at[0])] = True  # a text's end also ends a word
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(at), dtype=np.int64))
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, at - at[0])
    return Words(data, start, end, first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive hashes, by the place of the first; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = hashes[:size].copy()
        for k in range(1, n):
            out *= U64(0x9E3779B97F4A7C15)
            out += hashes[k : k + size]
    return mix(out)
