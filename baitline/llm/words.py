"""Words of whole text columns as numpy arrays.

A batch's texts stay in one byte buffer; word bounds and 64-bit word hashes are
computed for all texts of a block at once.  Temporary arrays are bounded by the
block (or by one text, in small types), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_SPAN = 1 << 17
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW = _powers(_R, _SPAN + 1)
_INV = _powers(pow(_R, -1, 1 << 64), _SPAN + 1)


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: ASCII white space, and everything that is neither an ASCII letter or digit nor a byte of a longer character.
SPACE = byte_class((0x09, 0x0D), (0x20, 0x20))
NOT_WORD = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (in place on a fresh array)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets within them."""
    data, offsets = texts(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the number of words before each row."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _long_hash(piece: np.ndarray) -> int:
    total, scale = 0, 1
    for at in range(0, len(piece), _SPAN):
        part = piece[at : at + _SPAN]
        total += scale * int((_POW[: len(part)] * (part.astype(_U) + _U(1))).sum(dtype=_U))
        scale = scale * pow(_R, len(part), 1 << 64) & _MASK
    return total & _MASK


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each [start, end) piece; pieces are in order and do not overlap."""
    out = np.empty(len(starts), _U)
    at, total = 0, len(starts)
    while at < total:
        base = starts[at]
        to = int(np.searchsorted(ends, base + _SPAN, "right"))
        if to <= at:
            out[at] = _long_hash(data[base : ends[at]])
            at += 1
            continue
        span = data[base : ends[to - 1]]
        sums = np.zeros(len(span) + 1, _U)
        np.cumsum(_POW[: len(span)] * (span + _U(1)), out=sums[1:])
        low, high = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[high] - sums[low]) * _INV[low]
        at = to
    return mix(out ^ ((ends - starts).astype(_U) << _U(48)))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words of one sequence of word hashes (across rows; see ``whole``)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _U(_R)
        out += words[k : k + n]
    return mix(out)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each word, from the running counts of ``bounds``."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))
