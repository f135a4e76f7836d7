"""Vectorised text kernels shared by the operators of this package.

Arrow hands a batch of texts over as one byte buffer with offsets.  The
functions below work on that buffer with numpy, so no Python object is made
for a character or a word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Space, tab, newline, vertical tab, form feed, carriage return.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Anything but ASCII letters, digits and what is beyond ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: A fixed random value for each byte.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def release() -> None:
    """Give freed memory back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives its memory back at the end of a task; a Python worker outlives many of them."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    return flat[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, at = texts(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


#: The lowest 0 to 8 bytes of eight.
_LOWEST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes.

    Each eight bytes are scrambled with their place before they are summed, so that no arrangement of the bytes cancels out.
    """
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    blocks = (size + 7) // 8
    span, place = grouped(blocks)
    value = eight[starts[span] + 8 * place] & _LOWEST[np.minimum(size[span] - 8 * place, 8)]
    value = mix(mix(value) + (place + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, np.cumsum(blocks) - blocks) ^ size.astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = WHITESPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and each text's first word."""
    starts, ends, first = word_spans(data, at, separator)
    return span_hashes(LOWER[data] if lower else data, starts, ends), starts, ends, first


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values (len(x) - n + 1 of them)."""
    if len(x) < n:
        return np.zeros(0, U64)
    out, width = None, 0
    power, size = x, 1
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            if out is None:
                out, width = power, size
            else:
                m = min(len(out) - size, len(power)) if len(out) > size else 0
                m = max(0, len(x) - width - size + 1)
                out = out[size : size + m] + power[:m] * U64((0xD6E8FEB86659FD93 + 2 * (bit + 64)) | 1)
                width += size
        if n >> (bit + 1):
            m = len(power) - size
            power = power[:m] * U64((0xA0761D6478BD642F + 2 * bit) | 1) + power[size:]
            power ^= power >> U64(32)
            power *= U64(0xBF58476D1CE4E5B9)
            power ^= power >> U64(29)
            size *= 2
    return mix(out)


def gathered(x: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that hold all the given spans of ``x``, and where each span begins in them; no more of them than ``x`` has."""
    if int(size.sum()) >= len(x):
        return x, begin
    span, place = grouped(size)
    return x[begin[span] + place], np.cumsum(size) - size


def grouped(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: each element's run, and its place within the run."""
    lengths = np.asarray(lengths, np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return run, np.arange(len(run)) - begin[run]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))
