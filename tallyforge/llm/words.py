"""Words and shingles of whole Arrow batches as numpy arrays of hashes.

A word is a maximal run of bytes other than blank and the controls 9 to 13.
Texts are hashed from the Arrow buffers in slices of a few megabytes, so the
memory of a task is bounded by the slice or by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    """Words of some documents: byte spans in ``data``, hashes, words per document."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random multipliers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_POWER = {"table": constants(64, 12)}


def _powers(n: int) -> np.ndarray:
    if len(_POWER["table"]) < n:
        _POWER["table"] = constants(2 * n, 12)
    return _POWER["table"]


def _buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        # More text than offsets of 32 bits can hold comes in chunks.
        column = column.cast(pa.large_string()).combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    raw = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    raw = raw[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), raw


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)


def words_of(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Words of consecutive documents, slice by slice."""
    data, offsets = _buffers(column)
    n, low = len(column), 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield _words(low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower)
        low = high


def _words(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = lower_ascii(data)
    inside = ~_BLANK[data]
    opens = inside.copy()
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    before = inside[:-1].copy()
    after = cuts[cuts > 0]
    before[after - 1] = False
    opens[1:] &= ~before
    start = np.flatnonzero(opens)
    closes = inside.copy()
    following = inside[1:].copy()
    following[after - 1] = False
    closes[:-1] &= ~following
    end = np.flatnonzero(closes) + 1
    count = np.diff(np.searchsorted(start, offsets))
    if not len(start):
        return Words(first, data, start, end, np.zeros(0, np.uint64), count)
    length = end - start
    place = np.flatnonzero(inside)
    within = place - np.repeat(start, length)
    value = _BYTE[data[place]] * _powers(int(length.max()))[within]
    value ^= value >> np.uint64(29)
    total = np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))
    return Words(first, data, start, end, mix(total + length.astype(np.uint64) * _GOLDEN), count)


def windows(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; one value per full window."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = constants(size, seed)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k:k + n] * factor[k]
    return mix(total)


def window_positions(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and position of every full window that lies in one document.

    Positions count over the words of all the documents.
    """
    full = np.maximum(count - size + 1, 0)
    document = np.repeat(np.arange(len(count)), full)
    base = np.cumsum(count) - count
    shift = np.repeat(base - (np.cumsum(full) - full), full)
    return document, np.arange(len(document)) + shift
