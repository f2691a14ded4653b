"""Vectorised per-text counts used by the quality operators."""

from __future__ import annotations

import numpy as np

from docloom.llm.textblocks import rows_of, span_hashes, window_hashes, word_spans

#: Code points that start a character: every byte but UTF-8 continuation bytes.
CHAR = np.ones(256, dtype=bool)
CHAR[0x80:0xC0] = False
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[0xC0:] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
STRONG = np.zeros(256, dtype=bool)
STRONG[list(b"!")] = True


def sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each span are in the mask."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the \\n-split lines of all rows, and each row's first line (one more than rows)."""
    n = len(buf)
    breaks = np.flatnonzero(buf == 10)
    counts = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads = np.zeros(first[-1], bool)
    heads[first[:-1]] = True
    tails = np.zeros(first[-1], bool)
    tails[first[1:] - 1] = True
    starts[heads], ends[tails] = offs[:-1], offs[1:]
    starts[~heads], ends[~tails] = breaks + 1, breaks
    return np.minimum(starts, n), np.minimum(ends, n), first


def repeated(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, whether its row has an equal earlier one, and whether it has any other equal one."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    same = np.zeros(len(order), bool)
    same[1:] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    later, twin = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    twin[order] = both
    return later, twin


def row_totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the given indexes."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def text_stats(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by row: words, characters in words, symbols, lines, duplicate lines, repeated 3-word windows and shapes."""
    starts, ends, first = word_spans(buf, offs)
    rows = rows_of(first)
    chars = sums(CHAR[buf], starts, ends)
    out = {"n_words": np.diff(first), "word_chars": row_totals(chars, first), "n_symbols": sums(SYMBOL[buf], offs[:-1], offs[1:])}
    words = span_hashes(buf, starts, ends)
    windows = window_hashes(words, 3)
    inside = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    _, twin = repeated(rows[inside], windows[inside])
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[inside[twin] + j] = True
    out["n_repeat_words"] = row_totals(covered, first)
    a, b, line = line_spans(buf, offs)
    full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    later, _ = repeated(rows_of(line)[full], span_hashes(buf, a[full], b[full]))
    dup = np.zeros(len(a), bool)
    dup[np.flatnonzero(full)[later]] = True
    out["n_dup_lines"] = row_totals(dup, line)
    out["n_lines"] = row_totals(full, line)
    out["n_upper"] = sums(UPPER[buf], offs[:-1], offs[1:])
    out["n_letters"] = sums(LETTER[buf], offs[:-1], offs[1:])
    out["n_strong"] = sums(STRONG[buf], offs[:-1], offs[1:])
    out["n_bare"] = row_totals(sums(LETTER[buf], starts, ends) == 0, first)
    out["n_short"] = row_totals(chars <= 3, first)
    return out
