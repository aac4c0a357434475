"""NumPy kernels over Arrow string batches: byte classes, word spans, 64-bit word hashes, ragged gathers.

Every kernel works on one slice of a batch at a time (``slices``), so that memory follows the slice and
the longest single text, never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Tables of powers up to this length are made as long as is asked for, to the next power of two, and stay between tasks.
KEPT_POWERS = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def trim() -> None:
    """Return freed memory to the system. Short tables of powers stay, as the tasks of small groups all need them."""
    if _powers and len(_powers[0]) > KEPT_POWERS:
        _powers.clear()
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # what is alive at the end of a worker's first task is mostly modules: later calls need not go through it
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` that returns its freed memory to the system when a task ends: workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about ``limit`` text bytes: (rows, bytes, offsets). A null text has no bytes."""
    at = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if n == 0:
        return
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a), whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def byte_table(chars: str | bytes, value: bool = True) -> np.ndarray:
    table = np.full(256, not value)
    table[list(chars.encode("latin-1") if isinstance(chars, str) else chars)] = value
    return table


#: Bytes that are not white space as the contracts define it: [\x20\x09-\x0D].
NOT_SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing A-Z: digits, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``mask`` inside each text: starts, ends, and for each text its first run (len + 1)."""
    n = len(mask)
    before = np.zeros(n + 1, bool)
    after = np.zeros(n + 1, bool)
    before[1:] = mask
    after[:n] = mask
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length()) if n <= KEPT_POWERS else max(n, SLICE_BYTES) + 1
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum over all bytes."""
    p, q = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        x = total[1:]  # all in one place: a slice takes eight times its bytes for it
        x += data
        x += np.uint64(1)
        x *= p[: len(data)]
        np.cumsum(x, out=x)
        h = (total[ends] - total[starts]) * q[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, k: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Rabin-Karp: for each i the hash of h[i:i+k], rolling by a prefix sum over powers modulo 2**64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, q = _power_tables(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * p[: len(h)], out=total[1:])
        return mix((total[k:] - total[:-k]) * q[:n] + np.uint64(base & _MASK))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all items of ragged rows, row after row."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
