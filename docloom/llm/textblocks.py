"""Vectorised word and window hashing over slices of Arrow text columns.

A word is a maximal run of bytes other than space and U+0009..U+000D. All work is on UTF-8 bytes held in numpy
arrays, in slices of bounded size, so a task's memory does not depend on how many rows an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_HASH_SPAN = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A prime that leaves room for products in 64 bits, and two bases of polynomials modulo it.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_103_515_245, 1_812_433_253)


@lru_cache(maxsize=8)
def _powers(base: int, modulus: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for factor in (base, pow(base, -1, modulus)):
        power = np.ones(size, np.uint64)
        have = 1
        while have < size:
            more = min(have, size - have)
            step = power[:more] * np.uint64(pow(factor, have, modulus))
            power[have : have + more] = step % _PRIME if modulus == int(_PRIME) else step
            have += more
        out.append(power)
    return out[0], out[1]


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, row offsets) of consecutive rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = word[:-1]
    after[:-1] = word[1:]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of ascending byte spans, by prefix sums of polynomials.

    Three polynomials are folded: one modulo 2**64, for which different long words of equal hash follow a rule, and two
    modulo a prime, for which none is known; spans are told apart by 126 bits before the fold to 64.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _HASH_SPAN, side="right")))
        s, e = starts[i:j] - base, ends[i:j] - base
        piece = buf[base : base + int(e[-1])]
        value = (LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)
        if len(value) <= _HASH_SPAN:
            whole, first, second = (_spans(value, s, e, *_powers(b, m, _HASH_SPAN + 1), m) for b, m in ((int(_P), 1 << 64), *((b, int(_PRIME)) for b in _BASES)))
        else:
            whole, first, second = (_long_span(value, b, m) for b, m in ((int(_P), 1 << 64), *((b, int(_PRIME)) for b in _BASES)))
        out[i:j] = whole + (e - s).astype(np.uint64) * _Q ^ mix64(first << np.uint64(31) | second)
        i = j
    return mix64(out)


def _spans(value: np.ndarray, s: np.ndarray, e: np.ndarray, up: np.ndarray, down: np.ndarray, modulus: int) -> np.ndarray:
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * up[: len(value)], out=sums[1:])
    got = sums[e] - sums[s]
    return got * down[s] if modulus > int(_PRIME) else got % _PRIME * down[s] % _PRIME


def _long_span(value: np.ndarray, base: int, modulus: int) -> np.ndarray:
    """One span that is longer than the tables of powers, piece by piece."""
    up, _ = _powers(base, modulus, _HASH_SPAN + 1)
    total, place = 0, 1
    for at in range(0, len(value), _HASH_SPAN):
        part = value[at : at + _HASH_SPAN]
        total = (total + int((part * up[: len(part)]).sum(dtype=np.uint64)) * place) % modulus
        place = place * pow(base, len(part), modulus) % modulus
    return np.array([total], np.uint64)


def window_hashes(words: np.ndarray, n: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hashes of all n consecutive words; windows that cross rows are left for the caller to drop."""
    size = max(0, len(words) - n + 1)
    acc = np.full(size, np.uint64(n * int(_Q) & 2**64 - 1))
    factor = np.uint64(1)
    for j in range(n if size else 0):
        acc += words[j : j + size] * factor
        factor = np.uint64((int(factor) * base) & (2**64 - 1))
    return mix64(acc)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_windows(first: np.ndarray, n: int) -> np.ndarray:
    """The word indexes at which a window of n words of a single row starts."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.arange(counts.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return at + shift


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct n-word shingles, A-Z lower-cased; a shorter text is one shingle, a blank one none."""
    starts, ends, first = word_spans(buf, offs)
    words = span_hashes(buf, starts, ends, lower=True)
    windows = window_hashes(words, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
