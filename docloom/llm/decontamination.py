"""Benchmark decontamination by SimHash over item-sized windows, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.textblocks import rows_of, span_hashes, text_slices, window_hashes, word_spans
from docloom.llm.workspace import Workspace

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 24
INDEX_BYTES = 8 << 20
#: Shingles that are compared at once.
PAIR_SHINGLES = 1 << 19
_BITS = np.arange(64, dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the given stretches, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _similarities(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of shingle sequences, laid end to end; a shingle weighs as often as it occurs.

    The k-th time that a shingle occurs in a sequence is an element of its own; equal elements of both sides are counted.
    """
    pairs = len(a_counts)
    pair = np.concatenate([np.repeat(np.arange(pairs), a_counts), np.repeat(np.arange(pairs), b_counts)])
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    value = np.concatenate([a, b])
    order = np.lexsort((side, value, pair))
    pair, side, value = pair[order], side[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (value[1:] != value[:-1])
    heads = np.flatnonzero(new)
    left = np.add.reduceat(side == 0, heads) if len(heads) else np.zeros(0, np.int64)
    right = np.diff(np.append(heads, len(order))) - left
    both = np.bincount(pair[heads], np.minimum(left, right), pairs)
    return both / (a_counts + b_counts - both)


class ItemGroup:
    """The items of one number of words: their shingles, fingerprints, and lists of telling shingles.

    A window at or over the threshold t has at least t * w of an item's w shingles. So it has one of any w - t * w + 1 of
    them, and the lists take those that the fewest items have: a phrase that all items share is in no list, unless an
    item has nothing else.
    """

    def __init__(self, size: int, shingle: int, threshold: float, members: list[tuple[object, np.ndarray]]):
        self.size, self.n = size, min(shingle, size)
        self.width = size - self.n + 1
        self.items = [i for i, _ in members]
        self.hashes = np.stack([h for _, h in members])
        self.prints = np.array([_fingerprints(_signs(h).sum(0, dtype=np.int32)[None])[0] for h in self.hashes], np.uint64)
        values, codes = np.unique(self.hashes, return_inverse=True)
        codes = codes.reshape(self.hashes.shape)
        own = [np.unique(c) for c in codes]
        held = np.bincount(np.concatenate(own), minlength=len(values))
        telling = self.width - int(np.ceil(threshold * self.width - 1e-9)) + 1
        first = [np.unique(c[np.lexsort((c, held[c]))][:telling]) for c in codes]
        item = np.repeat(np.arange(len(first)), [len(f) for f in first])
        code = np.concatenate(first)
        order = np.argsort(code, kind="stable")
        self.listed, at = np.unique(code[order], return_index=True)
        self.lists, self.starts, self.counts = item[order], at, np.diff(np.append(at, len(code)))
        self.seeds = values[self.listed]

    def meet(self, places: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) for each place whose shingle is in an item's list."""
        found = np.searchsorted(self.seeds, shingles[places])
        found = np.minimum(found, len(self.seeds) - 1)
        hit = self.seeds[found] == shingles[places]
        places, found = places[hit], found[hit]
        return np.repeat(places, self.counts[found]), self.lists[_ragged(self.starts[found], self.counts[found])]


class ItemIndex:
    """Benchmark items by number of words.

    Fingerprints are cut into radius + 1 blocks, so two fingerprints within the radius agree on one block at least. A
    window becomes a candidate for an item if it holds one of the item's telling shingles and its fingerprint agrees on
    a block and lies within the radius.
    """

    def __init__(self, items: list[tuple[object, str | None]], shingle: int, radius: int, threshold: float):
        self.shingle, self.radius, self.threshold = shingle, radius, threshold
        cuts = np.linspace(0, 64, radius + 2).round().astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        by_size: dict[int, list[tuple[object, np.ndarray]]] = {}
        for item, text in items:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
            if len(starts):
                n = min(shingle, len(starts))
                by_size.setdefault(len(starts), []).append((item, window_hashes(span_hashes(buf, starts, ends, lower=True), n)))
        self.groups = [ItemGroup(size, shingle, threshold, members) for size, members in sorted(by_size.items())]
        seeds = [g.seeds for g in self.groups]
        self.seeds = np.unique(np.concatenate(seeds)) if seeds else np.zeros(0, np.uint64)
        bits = max(16, int(np.ceil(np.log2(16 * len(self.seeds) + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[self.seeds & self.mask] = True

    def _near(self, group: ItemGroup, window: np.ndarray, item: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Which (window, item) pairs agree on a block and lie within the radius."""
        differ = prints[window] ^ group.prints[item]
        block = np.zeros(len(differ), bool)
        for shift, mask in self.blocks:
            block |= ((differ >> shift) & mask) == 0
        return block & (np.bitwise_count(differ) <= self.radius)

    def _similar(self, group: ItemGroup, shingles: np.ndarray, starts: np.ndarray, widths: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact similarities of stretches of shingles with items, in bounded batches."""
        each = max(1, PAIR_SHINGLES // (2 * group.width))
        out = [np.zeros(0)]
        for lo in range(0, len(starts), each):
            at, wide, own = starts[lo : lo + each], widths[lo : lo + each], group.hashes[item[lo : lo + each]]
            out.append(_similarities(shingles[_ragged(at, wide)], wide, own.ravel(), np.full(len(own), group.width)))
        return np.concatenate(out)

    def _whole_texts(self, group: ItemGroup, place: np.ndarray, item: np.ndarray, shingles: np.ndarray, row: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(row, item, similarity) of the texts with fewer words than the items of a group; such a text is one window."""
        counts = np.diff(first)
        # A text's shingles are a part of the item's at best, so one that is too short for the threshold is left out.
        short = (counts >= group.n) & (counts < group.size) & (counts - group.n + 1 >= self.threshold * group.width - 1e-9)
        here = short[row[place]]
        if not here.any():
            return
        pairs = np.unique(row[place[here]] * len(group.items) + item[here])
        rows, item = pairs // len(group.items), pairs % len(group.items)
        used, window = np.unique(rows, return_inverse=True)
        widths = counts[used] - group.n + 1
        sums = np.add.reduceat(_signs(shingles[_ragged(first[used], widths)]).astype(np.int32), np.cumsum(widths) - widths, axis=0)
        near = self._near(group, window, item, _fingerprints(sums))
        rows, item = rows[near], item[near]
        for r, i, got in zip(rows, item, self._similar(group, shingles, first[rows], counts[rows] - group.n + 1, item), strict=True):
            if got >= self.threshold:
                yield int(r), int(i), float(got)

    def _windows(self, group: ItemGroup, place: np.ndarray, item: np.ndarray, shingles: np.ndarray, row: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, item, similarity) of all windows at or over the threshold, from the places of telling shingles."""
        width, many = group.width, len(group.items)
        outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        each = max(1, PAIR_SHINGLES // width)
        # Places of one item stand together and in order, so that a window is met by one batch, or by two that follow.
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        for lo in range(0, len(place), each):
            pairs = np.unique((item[lo : lo + each, None] * (words + 1) + np.maximum(place[lo : lo + each, None] - np.arange(width), 0)).ravel())
            of, at = pairs // (words + 1), pairs % (words + 1)
            fits = at + group.size <= words
            of, at = of[fits], at[fits]
            fits = row[at] == row[at + group.size - 1]
            of, at = of[fits], at[fits]
            if not len(at):
                continue
            starts, window = np.unique(at, return_inverse=True)
            near = self._near(group, window, of, self._window_prints(starts, width, shingles))
            of, at = of[near], at[near]
            got = self._similar(group, shingles, at, np.full(len(at), width), of)
            over = got >= self.threshold
            outs.append((at[over], of[over], got[over]))
        at, of, got = (np.concatenate(c) for c in zip(*outs, strict=True))
        _, once = np.unique(of * (words + 1) + at, return_index=True)
        return at[once], of[once] % many, got[once]

    @staticmethod
    def _window_prints(starts: np.ndarray, width: int, shingles: np.ndarray) -> np.ndarray:
        """Fingerprints of windows by their first shingles: sums of signs along each stretch of neighbouring windows."""
        prints = np.empty(len(starts), np.uint64)
        for lo in range(0, len(starts), 4096):
            part = starts[lo : lo + 4096]
            used = np.unique((part[:, None] + np.arange(width)[None]).ravel())
            total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(shingles[used]), axis=0, dtype=np.int32)])
            at = np.searchsorted(used, part)
            prints[lo : lo + 4096] = _fingerprints(total[at + width] - total[at])
        return prints

    def search(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, object, float, int, int]]:
        """(row, item, best similarity, first word of the best window, windows at or over the threshold) in a slice."""
        starts, ends, first = word_spans(buf, offs)
        words = span_hashes(buf, starts, ends, lower=True)
        row = rows_of(first)
        best: dict[tuple[int, object], list] = {}
        for n in {g.n for g in self.groups}:
            shingles = window_hashes(words, n)
            hit = np.flatnonzero(self.sieve[shingles & self.mask])
            hit = hit[np.isin(shingles[hit], self.seeds)]
            for group in self.groups if len(hit) else ():
                if group.n != n:
                    continue
                place, item = group.meet(hit, shingles)
                for r, i, got in self._whole_texts(group, place, item, shingles, row, first):
                    best[r, group.items[i]] = [got, int(first[r]), 1]
                for at, i, got in zip(*(c.tolist() for c in self._windows(group, place, item, shingles, row, len(words))), strict=True):
                    now = best.setdefault((int(row[at]), group.items[i]), [got, at, 0])
                    now[2] += 1
                    if (-got, at) < (-now[0], now[1]):
                        now[:2] = got, at
        return [(r, i, s, p - int(first[r]), n) for (r, i), (s, p, n) in sorted(best.items())]


def _item_indexes(items: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, threshold: float, index_bytes: int) -> Iterator[tuple[bool, ItemIndex]]:
    """Indexes over parts of the benchmark, each of a bounded number of bytes, and whether there are others."""
    given = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    parts = max(1, -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // index_bytes))
    for k in range(parts):
        part = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        yield parts > 1, ItemIndex(sorted(map(tuple, part.distinct().collect())), shingle, radius, threshold)


def _leaks(batches: Iterator[pa.RecordBatch], index, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, buf, offs in text_slices(batch.column("text")):
            found = index.value.search(buf, offs)
            rows, items, sims, at, n = zip(*found, strict=True) if found else ([],) * 5
            ids = batch.column("id").take(pa.array([lo + r for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(items, item_type), pa.array(sims, pa.float64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())],
                names=["id", "item_id", "similarity", "start_word", "n_windows"],
            )


def _clean(batches: Iterator[pa.RecordBatch], index, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for lo, _, buf, offs in text_slices(batch.column(text_col)):
            keep[[lo + f[0] for f in index.value.search(buf, offs)]] = False
        yield batch.filter(pa.array(keep))


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """Returns (id, item_id, similarity, start_word, n_windows): the items that each row holds, with the best window.

    For an item of w words, the windows of w words of every text are compared with it; a text of fewer words, but enough
    for one of the item's shingles, is one window. SimHash fingerprints of their 5-word shingles (A-Z lower-cased,
    weighted by how often they occur) meet in Hamming blocks that miss no pair within the radius; of these pairs, exact
    weighted-shingle similarity decides on those that share one of the item's rarer shingles, which no match can lack. The
    benchmark is broadcast in parts of at most ``index_bytes`` of text, with one pass over the rows for each part. Of
    several parts, each one's leaks are written and its index is released before the next is made, so the benchmark may
    have any size.

    Defined cases: null or blank texts hold nothing, null or blank items are held by nothing; an item of fewer words
    than a shingle is one shingle; repeated items count once; repeated rows and null ids each give their own rows; ties
    between windows go to the first; a similarity of exactly the threshold is a leak; ids and item ids may be of any
    type; a text of any length is searched whole, in memory proportional to it; empty tables give an empty result;
    further columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = items.schema[item_id_col].dataType
    schema = f"id {given.schema['id'].dataType.simpleString()}, item_id {item_type.simpleString()}, similarity double, start_word long, n_windows long"
    out, ws = None, Workspace(spark, "leaks")
    for k, (several, index) in enumerate(_item_indexes(items, item_id_col, item_text_col, shingle, radius, threshold, index_bytes)):
        held = spark.sparkContext.broadcast(index)
        found = given.mapInArrow(lambda it, held=held: _leaks(it, held, to_arrow_type(item_type)), schema)
        if several:
            found = ws.table(f"part-{k}", found)
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def drop_leaking(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, shingle: int = SHINGLE, radius: int = RADIUS, index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows, with all their columns, that hold no item; cases as for ``find_leaks``."""
    out, ws = docs, Workspace(docs.sparkSession, "clean")
    for k, (several, index) in enumerate(_item_indexes(items, item_id_col, item_text_col, shingle, radius, threshold, index_bytes)):
        held = docs.sparkSession.sparkContext.broadcast(index)
        out = out.mapInArrow(lambda it, held=held: _clean(it, held, text_col), docs.schema)
        if several:
            out = ws.table(f"part-{k}", out)
            held.destroy()
            if k:
                ws.drop(f"part-{k - 1}")
    return out
