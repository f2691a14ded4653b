"""Product codes of vectors: codebooks by integer k-means over parts, nearest entries by memoised grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textblocks import mix64
from docloom.llm.workspace import Workspace

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: How many cells a task keeps for each part position; beyond that it starts anew.
CELLS = 1 << 16
_BLOCK = 1 << 13


class GridCells:
    """Nearest codebook entries of one part position, by cells of a grid.

    A cell is a box of ``width`` integers in every dimension. Its list has the entries that no other entry beats
    across the whole box: an entry leaves if its least distance to the box is above another's greatest. Lists are kept
    by a hash of the cell, and a vector is compared with its own cell's list only. Cells of equal hash are told apart
    by their coordinates; a vector whose cell is not the one that is kept is compared with every entry.
    """

    def __init__(self, book: np.ndarray, most: int = CELLS):
        self.book, self.most = book, most
        self.width = self._width()
        self.compared = 0
        self._forget()

    def _width(self) -> int:
        """A power of two at which a cell's diagonal is at most half the mean distance of an entry to the next one."""
        if len(self.book) < 2 or not self.book.shape[1]:
            return 1
        away = ((self.book[:, None, :] - self.book) ** 2).sum(axis=2).astype(float)
        np.fill_diagonal(away, np.inf)
        gap = float(np.sqrt(away.min(axis=1)).mean())
        return 1 << int(np.log2(max(gap / (2.0 * self.book.shape[1] ** 0.5), 1.0)))

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, self.book.shape[1]), np.int64)
        self.lists = np.zeros((0, len(self.book)), bool)

    def _hash(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), np.uint64)
        for j in range(cells.shape[1]):
            out = mix64(out ^ cells[:, j].astype(np.uint64))
        return out

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries can be nearest (or tie) somewhere in its box."""
        low = (cells * self.width)[:, None, :]
        high = low + (self.width - 1)
        least = (np.maximum(np.maximum(low - self.book, self.book - high), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(self.book - low), np.abs(self.book - high)) ** 2).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def _learn(self, hashes: np.ndarray, cells: np.ndarray) -> None:
        """Lists of cells whose hash is new."""
        lists = [self.undominated(cells[lo : lo + _BLOCK // 4]) for lo in range(0, len(cells), _BLOCK // 4)]
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.cells, self.lists = hashes[order], np.concatenate([self.cells, cells])[order], np.concatenate([self.lists, *lists])[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to each vector's nearest entry; ties go to the lower index."""
        parts = [self._nearest(x[lo : lo + _BLOCK]) for lo in range(0, len(x), _BLOCK)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = x // self.width
        hashes = self._hash(cells)
        distinct, first = np.unique(hashes, return_index=True)
        fresh = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + int(fresh.sum()) > self.most:
            self._forget()
            fresh[:] = True
        if fresh.any():
            self._learn(distinct[fresh], cells[first[fresh]])
        at = np.searchsorted(self.hashes, hashes)
        able = self.lists[at]
        able[(self.cells[at] != cells).any(axis=1)] = True
        row, entry = np.nonzero(able)
        self.compared += len(row)
        away = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        heads = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(away, heads)
        best = np.flatnonzero(away == least[row])
        lead = np.concatenate([[True], row[best][1:] != row[best][:-1]])
        return entry[best[lead]], least


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Drops unusable vectors; the others become 32-bit integers, packed."""
    for batch in batches:
        vectors = batch.column("v")
        has = pc.is_valid(vectors)
        batch, vectors = batch.filter(has), vectors.filter(has)
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(vectors)
        values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = bad[cuts[1:]] == bad[cuts[:-1]]
        whole = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
        inside = np.repeat(good, sizes)
        widest = int(sizes.max()) if len(sizes) else 0
        if inside.any() and 4 * float(np.abs(whole[inside]).max()) ** 2 * max(widest, 1) >= 2.0**62:
            raise ValueError(f"squared distances of components as large as {np.abs(values[inside]).max()} do not fit 64 bits")
        data = whole.astype(np.int64).astype("<i4")
        packed = pa.array([data[a:b].tobytes() for a, b in zip(cuts[:-1][good], cuts[1:][good], strict=True)], pa.binary())
        kept = batch.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), packed], names=["id", "label", "v"])


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x positions."""
    rows = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(rows, parts, -1) if rows else np.zeros((0, parts, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each part, entry and position, how many vectors took the entry and what they sum to; one set of rows a task."""
    parts, entries, size = books.shape
    grids = [GridCells(b) for b in books]
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
    for batch in batches:
        x = _matrix(batch.column("v"), parts)
        for p in range(parts if len(x) else 0):
            code, _ = grids[p].nearest(x[:, p])
            order = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            total[p, code[order][heads]] += np.add.reduceat(x[order, p], heads, axis=0)
            count[p] += np.bincount(code, minlength=entries)
    p, e = np.nonzero(count)
    columns = [np.repeat(p, size), np.repeat(e, size), np.tile(np.arange(size), len(p)), np.repeat(count[p, e], size), total[p, e].ravel()]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "position", "n", "total"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    grids = [GridCells(b) for b in books]
    for batch in batches:
        x = _matrix(batch.column("v"), len(books))
        code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
        for p in range(len(books) if len(x) else 0):
            near, away = grids[p].nearest(x[:, p])
            code[:, p] = near
            error += away
        text = code.tobytes().hex()
        step = 2 * len(books)
        named = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), named, pa.array(error)], names=["id", "label", "code", "error"])


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Returns a row for each kept vector (id, code, error, label_error), and the codebooks by part and entry.

    Components become ``floor(scale * x)`` and vectors are cut into equal parts. A part's codebook starts as that part
    of the ``entries`` vectors of smallest id. In each round every part goes to its nearest entry and an entry moves to
    the floored mean of its parts. ``code`` has two hex digits a part, ``error`` is the sum of squared distances, and
    ``label_error`` its sum over the rows of one label. A round is one narrow pass over the packed integers, whose
    tasks each send one sum per part, entry and position; the driver holds the codebooks alone. Labels meet their
    sums in a join, which Spark splits where a label is frequent.

    Defined cases: vectors that are null or hold null or non-finite components are dropped. Kept vectors must have one
    length, a multiple of ``parts``, and squared distances that fit 64 bits; others are refused with an error. With fewer
    kept vectors than ``entries`` the codebooks are as short; ids null come last, and equal ids in the order of their
    vectors; ties go to the lower index, unused entries stay; null labels are one label; an empty table gives an empty
    result and no codebooks; further columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    spark = vectors.sparkSession
    ws = Workspace(spark, "vector-codes")
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    name, label = (given.schema[c].dataType.simpleString() for c in ("id", "label"))
    packed = ws.table("integers", given.mapInArrow(lambda it: _integers(it, scale), f"id {name}, label {label}, v binary"))
    shortest, longest = packed.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    books = np.zeros((parts, 0, 0), np.int64)
    if longest is not None:
        if shortest != longest or not longest or longest // 4 % parts:
            raise ValueError(f"vectors of {shortest // 4} to {longest // 4} components are not of one length that {parts} parts divide")
        first = packed.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        books = np.stack([np.frombuffer(r.v, "<i4").astype(np.int64).reshape(parts, -1) for r in first], axis=1)
        for _ in range(rounds):
            books = _moved(packed, books)
    coded = ws.table("codes", packed.mapInArrow(lambda it: _codes(it, books), f"id {name}, label {label}, code string, error long"))
    sums = ws.table("labels", coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select(F.col("id").alias(id_col), "code", "error", "label_error")
    return out, books.tolist()


def _moved(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    sums = packed.select("v").mapInArrow(lambda it: _sums(it, books), "part long, entry long, position long, n long, total long")
    sums = sums.groupBy("part", "entry", "position").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")])
    out = books.copy()
    for r in sums.collect():  # parts x entries x positions rows
        out[r.part, r.entry, r.position] = int(r.total) // int(r.n)
    return out
