"""Whole-batch tokenization for Arrow tasks: words, word hashes and rolling hashes.

A word is a maximal run of bytes other than space and U+0009..U+000D (all white space of
that set is one byte in UTF-8, so bytes and characters agree).  Everything works on the
buffers of an Arrow string column; no Python object is made per word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93            # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer words are hashed one by one.
_LONG_WORD = 512
#: [n]: the low n bytes of a word of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of text that one step of a task holds in arrays (one longer text is one step).
STEP_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a fixed bijection of 64-bit names."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the ordered pair (a, b)."""
    return mix(mix(a + _K1) * _K3 + b)


class Words:
    """The words of some texts, in order.

    ``start``/``end`` are byte offsets into ``data``; ``first[i]:first[i + 1]`` are the
    words of text i; ``name`` holds a 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.text_start, self.text_end = offsets[:-1], hi
        inside = ~SPACE[data[lo:hi]]
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cuts = offsets[1:-1] - lo                     # where one text meets the next
            cuts = cuts[(cuts > 0) & (cuts < n)]
            begins[cuts] |= inside[cuts]
            ends[cuts - 1] |= inside[cuts - 1]
        self.start = np.flatnonzero(begins) + lo
        self.end = np.flatnonzero(ends) + 1 + lo
        self.first = np.searchsorted(self.start, offsets)

    @functools.cached_property
    def name(self) -> np.ndarray:
        return self.hashes(0)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of every word's bytes, taken eight at a time."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + _K1 + np.uint64(seed))
        if not len(size):
            return h
        lo = int(self.start[0])
        text = np.concatenate([self.data[lo:int(self.end[-1])], np.zeros(8, np.uint8)])
        eight = np.ndarray(len(text) - 7, "<u8", text.data, strides=(1,))     # at every byte
        at = self.start - lo
        live = slice(None) if size.max() <= _LONG_WORD else np.flatnonzero(size <= _LONG_WORD)
        where, left, j = at[live], size[live], 0
        while len(left):
            part = eight[where + j] & _LOW[np.minimum(left - j, 8)]
            h[live] = mix(h[live] * _K3 + part)
            j += 8
            more = left > j
            live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
            where, left = where[more], left[more]
        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(text[at[i]:at[i] + size[i]].tobytes(), seed)
        return h

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Rolling:
    """Hashes of any slice of a sequence of names, from prefix sums modulo 2**64."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        power = np.full(n + 1, _BASE, dtype=np.uint64)
        back = np.full(n + 1, _INVERSE, dtype=np.uint64)
        power[0] = back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(names * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        part = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(part + (end - start).astype(np.uint64) * _K1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def steps(batches, text: str = "text", limit: int = STEP_BYTES):
    """(record batch, Words) over whole texts, about ``limit`` bytes of text at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), Words(data, offsets[row:end + 1])
            row = end


def signed(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)
