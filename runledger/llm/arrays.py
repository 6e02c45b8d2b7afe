"""Numpy helpers that work on the bytes of many texts at once, inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes, so that work arrays stay small.
SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Powers are kept for one block of positions; those of any position are a product of two.
_BLOCK = 1 << 15
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 … base^n modulo 2^64, or the powers of its inverse. A worker keeps a block of 256 KB for each base, whatever
    texts it has seen."""
    step = pow(base, -1, 1 << 64) if inverse else base
    low = _POWERS.get((base, inverse))
    if low is None:
        low = np.full(_BLOCK, step, dtype=U)
        low[0] = 1
        low = _POWERS[base, inverse] = np.cumprod(low)
    if n < _BLOCK:
        return low[: n + 1]
    high = np.full(n // _BLOCK + 1, pow(step, _BLOCK, 1 << 64), dtype=U)
    high[0] = 1
    return (np.cumprod(high)[:, None] * low).ravel()[: n + 1]


def polynomial(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of value * base^position; span_hash() reads the hash of any run from them."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, base: int, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hash of the runs [start, end), independent of where they lie."""
    return (sums[end] - sums[start]) * powers(base, len(sums) - 1, True)[start]


def run_hashes(values: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of every run of k neighbours: len(values) - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = polynomial(values, base)
    return mix((sums[k:] - sums[:-k]) * powers(base, len(values), True)[:n] + U(k))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    return run_hashes(_BYTE_CODES[data], k, _BASE)


#: Of the GNU C library; others have no such function.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that Arrow and numpy hold but no longer use back to the system, as Spark keeps idle workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the bytes of their texts and the offsets of each text. A null text is empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
        del batch, texts, offsets, data
        release()


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text number of each word; words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hash(polynomial(_BYTE_CODES[data], _BASE), _BASE, start, end) + (end - start).astype(U))


def same_text(text_of: np.ndarray, k: int) -> np.ndarray:
    """For each run of k words whether it lies in one text."""
    n = len(text_of) - k + 1
    return text_of[:n] == text_of[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of width values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, done = values, 1
    while done * 2 <= width:
        out, done = pick(out[: len(out) - done], out[done:]), done * 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest hash of some run of width positions. Equal content has equal anchors."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= width:
        return np.flatnonzero(hashes == hashes.min())
    least = sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in a run [start, start + length)."""
    change = np.bincount(start, minlength=n + 1)[: n + 1].astype(np.int64)
    change -= np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] … start[0] + length[0] - 1, start[1] …, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def binary_runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[bounds[i] : bounds[i + 1]] as the bytes of row i."""
    raw, size = np.ascontiguousarray(values), values.dtype.itemsize
    at = (np.asarray(bounds) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])
