"""Vectorised text primitives over Arrow batches: byte arrays, word hashes, bounded slices.

Everything works on UTF-8 bytes, so no text is decoded row by row. A word is a run of
bytes outside space and 0x09-0x0D, the class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_SIZE_SALT = np.uint64(0xD6E8FEB86659FD93)
#: The low bytes of a little-endian lane.
_LANE_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system at its end: Python workers live on and idle ones count too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling-hash base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < max(n, 1):
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _POWERS[name] = np.multiply.accumulate(grown)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` bytes, the same for equal windows.

    For finding candidates and cut points in short windows only: a polynomial modulo 2**64 has long
    texts that collide, so nothing may take equal hashes for equal bytes.
    """
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=prefix[1:])
    m = len(data) - width + 1
    return mix((prefix[width:] - prefix[:-width]) * powers(m)[1] + np.uint64(width))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same for equal bytes wherever they stand.

    Each lane of eight bytes is mixed with its number before lanes are added up, so neither exchanged nor
    repeated parts cancel out.
    """
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = np.maximum(end - start, 0)
    number = np.maximum((size + 7) >> 3, 1)
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    edges = np.concatenate([[0], np.cumsum(number)])
    for a, b in slices(edges, 1 << 20):
        n = number[a:b]
        begin = edges[a:b] - edges[a]
        within = np.arange(edges[b] - edges[a]) - np.repeat(begin, n)
        at = np.repeat(start[a:b], n) + 8 * within
        left = np.minimum(np.repeat(end[a:b], n) - at, 8)  # bytes of the lane inside the span
        value = lanes[np.minimum(at, len(data))] & _LANE_MASKS[np.maximum(left, 0)]
        value = mix(value + (within.astype(np.uint64) + np.uint64(1)) * _BASE)
        out[a:b] = np.add.reduceat(value, begin)
    return mix(out + size.astype(np.uint64) * _SIZE_SALT)


def byte_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 offsets; nulls are empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else kind)
    column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[where[0] : where[-1]], where - where[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone, so each row stays whole."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of bounded runs of rows."""
    data, offsets = byte_columns(column)
    for a, b in slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~WHITE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and the row that holds it."""
    if lower:
        data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    return span_hash(data, starts, ends), rows


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """For sorted row numbers, the n + 1 positions where each row begins."""
    return np.searchsorted(rows, np.arange(n + 1))


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[offsets[1:]] - lead[offsets[:-1]]
