"""Vectorised scans over the UTF-8 buffers of Arrow batches: words, their hashes, windows.

Everything works on slices of half a MB (a longer text is a slice of its own), so memory
does not depend on how Spark cuts its batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 19

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Slice:
    """Some rows of a batch: their bytes, and where each row begins and ends in them."""

    rows: pa.RecordBatch
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without copying; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[Slice]:
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_buffer(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
            b = min(b, batch.num_rows)
            yield Slice(batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word ([^\\x20\\x09-\\x0D]+) in data, and for each row the index of its first word (and the total)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, bounds)


#: Words of more bytes are hashed one by one.
_LONG = 64
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, parts: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with two parts, 128 bits as rows of two.

    Words are taken in eight bytes at a time, each mixed into the state by a bijection, so
    that no two words collide by the way they are built.
    """
    n = len(begin)
    size = end - begin
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    state = [mix(size.astype(_U) + _U(0x51ED270B * (k + 1))) for k in range(parts)]
    row, at, left = np.arange(n), begin, size
    if n and int(size.max()) > _LONG:
        for k in np.flatnonzero(size > _LONG).tolist():
            digest = xxhash.xxh3_128_intdigest(data[begin[k] : end[k]].tobytes())
            for one, part in zip(state, (digest & (1 << 64) - 1, digest >> 64), strict=False):
                one[k] = part
        row = np.flatnonzero(size <= _LONG)
        at, left = begin[row], size[row]
    odd = (_P, _Q)
    with np.errstate(over="ignore"):
        while len(row):
            chunk = eight[at] & _BELOW[np.minimum(left, 8)]
            for k in range(parts):
                if len(row) == n:
                    state[k] = mix(state[k] * odd[k] + chunk)
                else:
                    state[k][row] = mix(state[k][row] * odd[k] + chunk)
            more = left > 8
            row, at, left = row[more], at[more] + 8, left[more] - 8
    return state[0] if parts == 1 else np.stack(state, 1)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The 64-bit hash of the ``size`` words that begin at each word, by doubling: windows of 2n words are pairs of windows of n."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        done, wide, out, have = 0, 1, None, hashes
        while True:
            if size & wide:
                part = have[done : done + n]
                out = part if out is None else mix(out * _P ^ part)
                done += wide
            if done == size:
                return mix(out + _U(size) * _Q)
            have = mix(have[: len(have) - wide] * _Q + _U(wide) ^ have[wide:])
            wide *= 2


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words at which a window of ``size`` words of one row begins, and their rows."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row], row
