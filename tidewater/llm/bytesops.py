"""Vectorised byte-level helpers used inside Spark tasks (numpy on Arrow buffers).

All functions work on one contiguous ``uint8`` buffer that holds several texts end to end, with
``offsets[i]:offsets[i + 1]`` the bytes of text ``i``. Hashes are 64-bit polynomial fingerprints with a
finishing mix; two different strings collide with probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once; keeps each 8-byte work array at 4 MB, whatever the batch.
SLICE_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing mix of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step % (1 << 64)
        done += take
    return out


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept for the worker's life."""

    up = _powers(SLICE_BYTES + 8, _BASE)
    down = _powers(SLICE_BYTES + 8, _BASE_INV)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            return _powers(n, _BASE), _powers(n, _BASE_INV)
        return cls.up, cls.down


#: A fixed random 64-bit value for each byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """``out[i]`` is the running polynomial hash of ``data[:i]`` (not mixed)."""
    up, _ = _Powers.upto(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    value = code[data]
    value *= up[: len(data)]
    np.cumsum(value, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``."""
    _, down = _Powers.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of ``width`` bytes."""
    n = len(prefix) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = _Powers.upto(len(prefix))
    return mix((prefix[width:] - prefix[:n]) * down[:n])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of a string or binary column; nulls count as empty.

    Rows stay whole, so one row longer than ``limit`` makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: With these, texts are hashed as if A-Z were lower case.
LOWER_CODE = BYTE_CODE[_LOWER]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, for each text, where its words begin in them (length: texts + 1).

    Words are maximal runs of non-space bytes that never cross a text's border.
    """
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(space[data], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2].copy(), edge[1::2].copy()
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    if len(cut):
        cut = np.unique(cut)
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word on both sides of the border
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(word_hash: np.ndarray, first: int, last: int, size: int) -> np.ndarray:
    """Hashes of the ``size``-word shingles of the words ``[first, last)``; a shorter text is one shingle."""
    n = last - first
    if n <= 0:
        return np.empty(0, np.uint64)
    w = word_hash[first:last]
    width = min(size, n)
    m = n - width + 1
    out = np.full(m, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + w[k : k + m]
    return mix(out)


_PLACE = np.uint64(24)
_SPAN = 1 << 23


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least value (by its upper 40 bits, then the leftmost) of each window, without repeats."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    if n > 2 * _SPAN + width:  # positions have 24 bits: take overlapping stretches
        parts = [sliding_argmin(values[a : a + _SPAN + width - 1], width) + a for a in range(0, n - width + 1, _SPAN)]
        return np.unique(np.concatenate(parts))
    key = (values >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    if pad:
        key = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)])
    blocks = key.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    low = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]  # a window's least position never moves back
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)
