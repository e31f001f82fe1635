"""Words and shingles of Arrow text batches as numpy arrays, without a Python object for each word.

Words are runs of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes occur only as the ASCII blanks.
Hashes are 64 bits. A batch is taken in slices of whole texts, so memory follows the slice or the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8: powers of it differ in low bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give memory back at the end of a task: Python workers stay alive, and what they hold counts against the next stage."""
    pa.default_memory_pool().release_unused()
    _powers.clear()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_PLACES = mix(np.arange(1000, 1016, dtype=np.uint64)) | np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the longest table asked for is kept."""
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(n, SLICE_BYTES), base, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table)
    return _powers[base][:n]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null counts as empty. The bytes are a view: don't write to them."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never spans two rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one running sum over the slice."""
    if not len(start):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=run[1:])
    return mix((run[end] - run[start]) * _power(_INVERSE, len(data))[start])


def word_rows(column: pa.Array, lower: bool = True, blank: np.ndarray = _BLANK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all words of the slice, where each row's words begin and the last end)."""
    for first, data, offsets in slices(column):
        data = _LOWER[data] if lower else data
        start, end, row = words(data, offsets, blank)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        yield first, word_hashes(data, start, end), bounds


SHINGLE_BITS = 56


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): shingles of ``width`` words, or all words where there are fewer; none without words.

    Hashes have ``SHINGLE_BITS`` bits: what is sent for each shingle is mostly its hash.
    """
    for first, hashes, bounds in word_rows(column):
        n = max(0, len(hashes) - width + 1)
        long = np.zeros(n, np.uint64)
        for k in range(width):
            long += hashes[k : k + n] * _PLACES[k]
        cut = np.uint64(64 - SHINGLE_BITS)
        long = mix(long) >> cut
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                yield first + i, np.unique(long[a : b - width + 1])
            elif b > a:
                short = (hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64)
                yield first + i, mix(np.array([short], np.uint64) + _PLACES[8 + b - a]) >> cut
            else:
                yield first + i, np.zeros(0, np.uint64)


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes."""
    total = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: planes that hardly vary all but vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values, as their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
