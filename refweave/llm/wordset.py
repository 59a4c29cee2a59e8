"""Words and word shingles of whole texts as 64-bit hashes, by array arithmetic on UTF-8 bytes.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
PIECE = 1 << 20  # bytes that are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
        k += m
    return out


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in bytes that begin and end at word bounds."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(data) > PIECE:  # one word of more than a piece
        up, down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
    else:
        up, down = _UP, _DOWN
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and each text's first word (one more at the end).

    Bytes are cut at spaces or text bounds near every PIECE, so arrays stay small
    however long a text is.
    """
    bounds = [int(offsets[0])]
    while bounds[-1] < offsets[-1]:
        lo, hi = bounds[-1], min(bounds[-1] + PIECE, int(offsets[-1]))
        if hi < offsets[-1]:
            k = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:
                gaps = np.flatnonzero(_SPACE[data[lo:hi]])
                while not len(gaps) and hi < offsets[k + 1]:
                    step = data[hi : min(hi + PIECE, int(offsets[k + 1]))]
                    gaps = np.flatnonzero(_SPACE[step]) + (hi - lo)
                    hi += len(step)
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        bounds.append(hi)
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        piece = data[lo:hi]
        if len(inner):  # a byte of space between texts keeps their words apart
            piece = np.insert(piece, inner, 32)
        s, h = _hash_piece(piece)
        if len(inner):
            s = s - np.searchsorted(inner + np.arange(1, len(inner) + 1), s, "right")
        starts.append(s + lo)
        hashes.append(h)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, offsets, "left")


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and each text's first (one more at the end)."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate(([0], np.cumsum(count)))
    total = int(begin[-1])
    if not total:
        return np.zeros(0, np.uint64), begin
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + (np.arange(total) - begin[:-1][text])
    size = np.minimum(n, width)[text]
    acc = size.astype(np.uint64) * _STEP[1]
    for k in range(width):
        w = words[np.minimum(at + k, len(words) - 1)]
        acc += np.where(k < size, mix(w + _STEP[2 + k]) * _STEP[20 + k], np.uint64(0))
    acc = mix(acc)
    order = np.lexsort((acc, text))
    acc, text = acc[order], text[order]
    fresh = np.concatenate(([True], (acc[1:] != acc[:-1]) | (text[1:] != text[:-1])))
    acc, text = acc[fresh], text[fresh]
    return acc, np.searchsorted(text, np.arange(len(n) + 1), "left")


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    bits = column.buffers()
    offsets = np.frombuffer(bits[1], np.int64)[column.offset : column.offset + len(column) + 1] if bits[1] else np.zeros(1, np.int64)
    data = np.frombuffer(bits[2], np.uint8) if bits[2] is not None and bits[2].size else np.zeros(0, np.uint8)
    return data, offsets


def tidy() -> None:
    """Give memory that is free back to the system: a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def runs(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = texts(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    tidy()
