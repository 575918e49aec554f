"""Vectorised fingerprints over the UTF-8 bytes of many texts at once.

A text's bytes are mapped to fixed random 64-bit numbers and summed with powers of an odd base modulo 2**64, so the
fingerprint of any byte range is one subtraction and one product. Everything is a pure function of the bytes: workers
and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd bases of the two fingerprints, and the seed of the byte tables.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEED = 20240229
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); bijective."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class Fingerprints:
    """Prefix sums of one base; range(s, e) gives the fingerprints of byte ranges."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        bytes_, up, down = self._tables.get(which, (None, np.ones(1, _U), np.ones(1, _U)))
        if len(up) <= len(data):
            n = (len(data) // 65536 + 1) * 65536
            with np.errstate(over="ignore"):
                up = np.concatenate([np.ones(1, _U), np.full(n, base, _U)]).cumprod(dtype=_U)
                down = np.concatenate([np.ones(1, _U), np.full(n, pow(base, -1, 1 << 64), _U)]).cumprod(dtype=_U)
            bytes_ = np.random.default_rng(SEED + which).integers(0, 1 << 64, 256, dtype=_U)
            self._tables[which] = (bytes_, up, down)
        self.down = down
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(bytes_[data] * up[: len(data)], out=self.sums[1:])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + end.astype(_U) - start.astype(_U))

    def windows(self, width: int) -> np.ndarray:
        """The fingerprints of every range of this width, by start."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + _U(width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of this many values, by start (length len(x) - width + 1)."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts as (first row, row after the last, their bytes, offsets); nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    if column.offset:
        column = pa.concat_arrays([column])
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


#: The six bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words `[^\\x20\\x09-\\x0D]+`; words end where texts end."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first)) if len(data) else np.zeros(0, np.int64)
    after = np.concatenate([~inside[1:] | first[1:], [True]]) if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def without_space(data: np.ndarray) -> np.ndarray:
    """The bytes of all words, end to end."""
    return np.ascontiguousarray(data[~_SPACE[data]])
