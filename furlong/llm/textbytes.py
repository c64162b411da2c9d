"""Vectorised helpers over the UTF-8 bytes of Arrow string batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time inside a task; bounds the working arrays, not the text.
SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def release() -> None:
    """Hand memory that is free back to the machine; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run: Callable) -> Callable:
    """A function over batches that releases memory at its end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def lean_group(run: Callable) -> Callable:
    """A function of one group that releases memory at its end."""

    def inner(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return inner


def lean_pair(run: Callable) -> Callable:
    """A function of two groups that releases memory at its end."""

    def inner(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return inner


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets into them; null counts as empty."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1 + arr.offset)[arr.offset :]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text has a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(n, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: sums[i] covers buf[:i]."""
    up, _ = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    # in place: three arrays of eight bytes for each of buf's are not alive at once
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(buf)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]; equal bytes have equal hashes wherever they stand."""
    _, down = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(keep: str) -> np.ndarray:
    """256 flags. "letters": ASCII letters, digits and all bytes of longer characters; "spaced": all but white space."""
    table = np.zeros(256, bool)
    if keep == "letters":
        for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
            table[a:b] = True
    else:
        table[:] = True
        table[[9, 10, 11, 12, 13, 32]] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each text the number of words before it (n+1 values)."""
    inside = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)
