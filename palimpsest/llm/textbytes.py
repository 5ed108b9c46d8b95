"""Vectorised work on the UTF-8 bytes of many texts at once (numpy over Arrow buffers).

A block is the bytes of several whole texts laid end to end with their offsets. Every function works on whole
texts; blocks only bound the memory in use. Spans are hashed eight bytes at a time, each step passing through a
64-bit finaliser, so that no algebraic identity of a polynomial makes two spans equal; long spans go to xxh3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BLOCK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift multiplications)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive whole texts, about ``most`` bytes each."""
    data, offsets = column_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


LONG = 256  # bytes from which a span is hashed by itself
_STEPS = [U(x) for x in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
_PART = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)


class Hasher:
    """Hashes of any spans of one block."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.padded = np.zeros(len(data) + 8, np.uint8)
        self.padded[: len(data)] = data
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.padded, 0, (1,))  # the eight bytes from each place on

    def chunk(self, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The first eight bytes from each start, zero from ``left`` on."""
        return self.eight[start] & _PART[np.minimum(left, 8)]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(U) * _STEPS[0] + _STEPS[1])
        live = np.flatnonzero(size <= LONG) if len(size) and size.max() > LONG else np.arange(len(size))
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[start[k] : end[k]].tobytes(), int(size[k]))
        at, left, state = start[live], size[live], out[live]
        while len(live):
            state = mix((state ^ self.chunk(at, left)) * _STEPS[2])
            more = left > 8
            out[live] = state
            live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
        return out


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes outside ``apart``; no run crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_STEP = [U(x) for x in (0xF1357AEA2E62A9C5, 0x9E6C63D0876A9A47, 0xB5026F5AA96619E9, 0xC2B2AE3D27D4EB4F, 0x8CB92BA72F3D8DD7)]


def windows(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, and the index of each window's first word."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(count, U)
    for k in range(width):
        total = total * _STEP[0] + mix(words[k : k + count] * _STEP[1 + k % 4])
    first = np.flatnonzero(row[:count] == row[width - 1 :])
    return mix(total[first] + U(width)), first
