"""Compact binary columns: many numbers in one row, so that a shuffle moves few and large records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as differences from their minimum, in as few bytes as the largest needs."""
    if not len(values):
        return b""
    low = int(values.min())
    gap = (values - low).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if int(gap.max()) < 1 << 8 * w)
    return np.array([low, width], np.int64).tobytes() + gap.astype(f"u{width}").tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    low, width = np.frombuffer(data, np.int64, 2)
    return np.frombuffer(data, f"u{width}", offset=16).astype(np.int64) + low


def ragged_binary(values: np.ndarray, cuts: np.ndarray, most: int = 2**31 - 1) -> pa.ChunkedArray:
    """A binary column whose rows are the values between consecutive cuts, in chunks that 32-bit offsets can hold."""
    offsets = cuts.astype(np.int64) * values.dtype.itemsize
    if len(cuts) > 1 and int(np.diff(offsets).max()) > most:
        raise OverflowError(f"a value of {int(np.diff(offsets).max())} bytes is over the {most} bytes that a binary value can have")
    data = np.ascontiguousarray(values).view(np.uint8)
    chunks, lo = [], 0
    while lo < len(cuts) - 1:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        part = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int32)
        chunks.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(part.tobytes()), pa.py_buffer(data[offsets[lo] : offsets[hi]].tobytes())]))
        lo = hi
    return pa.chunked_array(chunks, pa.binary())


def by_id(ids: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct ids, cuts between their rows, and the columns in that order."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]).astype(np.int64) if len(ids) else np.zeros(1, np.int64)
    return ids[cuts[:-1]], cuts, [c[order] for c in columns]
