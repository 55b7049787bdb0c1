"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing
A-Z. All of those are ASCII, so cutting UTF-8 bytes is the same as cutting code
points. A word's hash is a polynomial over random byte values, read off one
prefix sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = _VALUES[_LOWER]  # lower-casing costs nothing more
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_POWERS: dict[str, np.ndarray] = {}

#: Text bytes hashed at a time; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # pyarrow keeps several chunks for huge columns
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding about ``most`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a block, documents' n + 1 offsets into them, and the words' first and end bytes.

    A document without words has an empty range.
    """
    n = len(data)
    solid = _SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    inner = cut[(cut > 0) & (cut < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    return hashes, np.searchsorted(start, offsets).astype(np.int64), start, end


def batches(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of documents: first and end row, word hashes, offsets into them."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets):
        part = offsets[lo : hi + 1]
        h, at, _, _ = words(data[part[0] : part[-1]], part - part[0])
        yield lo, hi, h, at
