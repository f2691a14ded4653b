"""Packing documents into windows of equal length by the sum-of-squares rule."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.token_ids import text_encoder

WINDOW = 1024
OPEN_WINDOWS = 4096
BATCH_BYTES = 4 << 20
#: Windows of one task have ids of their own range.
TASK_BITS = 36

#: (row, first id, ids) of a piece.
Piece = tuple[int, int, np.ndarray]


class LevelArray:
    """How many windows are filled to each level, and the place that keeps these counts most even.

    For an item, the cost of a level is how much the sum of squared counts grows if a window of that level takes the
    item: a window leaves its level and reaches a higher one, and full windows leave the array. Level 0 opens a window.
    Both terms are kept for all levels, so a place is one vector sum and its minimum; ties go to the fullest window.
    """

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.leave = np.full(size + 1, np.inf)
        self.leave[0] = 0.0
        self.reach = np.ones(size + 1)
        self.reach[size] = 0.0

    def place(self, item: int) -> int:
        """The level whose window takes an item of 1 to ``size`` tokens."""
        cost = self.leave[: self.size - item + 1] + self.reach[item:]
        return self.size - item - int(np.argmin(cost[::-1]))

    def change(self, level: int, by: int) -> None:
        if 0 < level < self.size:
            n = self.count[level] = self.count[level] + by
            self.leave[level] = 1.0 - 2.0 * n if n else np.inf
            self.reach[level] = 2.0 * n + 1.0


class WindowPacker:
    """Packs a stream of documents; windows come out when they are full, the others at the end or when too many are open."""

    def __init__(self, size: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.size, self.most_open = size, most_open
        self.levels = LevelArray(size)
        self.at: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.open = 0

    def add(self, row: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Whole windows of a long document leave at once; what remains of it is placed."""
        whole = len(ids) - len(ids) % self.size
        for lo in range(0, whole, self.size):
            yield [(row, lo, ids[lo : lo + self.size])]
        if whole == len(ids):
            return
        rest = (row, whole, ids[whole:].copy())
        item = len(rest[2])
        level = self.levels.place(item)
        window = self.at[level].pop() if level else []
        self.levels.change(level, -1)
        window.append(rest)
        if level + item == self.size:
            self.open -= 1
            yield window
        else:
            self.at[level + item].append(window)
            self.levels.change(level + item, 1)
            self.open += not level
            if self.open > self.most_open:
                yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Closes all open windows without padding.

        Windows filled to a power of two stay as they are. The others' pieces, fullest windows first, are laid end to
        end and cut at every ``size``; what is left at the end is cut into powers of two.
        """
        loose: list[Piece] = []
        for level in range(self.size - 1, 0, -1):
            for window in self.at[level]:
                if level & (level - 1):
                    loose += window
                else:
                    yield window
            self.at[level] = []
            self.levels.change(level, -int(self.levels.count[level]))
        self.open = 0
        left = sum(len(p[2]) for p in loose)
        window: list[Piece] = []
        room = self._next(left)
        for row, start, ids in loose:
            while len(ids):
                take = min(room, len(ids))
                window.append((row, start, ids[:take]))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    yield window
                    window, room = [], self._next(left)

    def _next(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(left.bit_length() - 1, 0)


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, most_open: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode, packer = text_encoder(path), WindowPacker(size, most_open)
    sequence = TaskContext.get().partitionId() << TASK_BITS
    seen: dict[int, tuple[object, int, int]] = {}
    rows: list[tuple] = []
    held, row, kind = 0, 0, None

    def emit(window: list[Piece]) -> None:
        nonlocal sequence, held
        offset = 0
        for at, start, ids in window:
            name, total, left = seen[at]
            rows.append((name, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
            offset += len(ids)
            held += 4 * len(ids)
            if left == len(ids):
                del seen[at]
            else:
                seen[at] = (name, total, left - len(ids))
        sequence += 1

    def flush() -> pa.RecordBatch:
        nonlocal held
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)]
        rows.clear()
        held = 0
        return pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        kind = batch.column("id").type
        names, texts = batch.column("id"), batch.column("text")
        for i in range(batch.num_rows):
            ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id))
            seen[row] = (names[i].as_py(), len(ids), len(ids))
            for window in packer.add(row, ids):
                emit(window)
                if held >= BATCH_BYTES:
                    yield flush()
            row += 1
    if kind is not None:
        for window in packer.settle():
            emit(window)
        yield flush()


def pack_sequences(
    docs: DataFrame, tokenizer_path: str, size: int = WINDOW, end_id: int = 0, most_open: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Returns a row for each piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its token ids and ``end_id``; ``start`` counts its ids before the piece, ``ids`` holds the piece's ids
    as little-endian unsigned 32-bit numbers. Each task packs the documents it reads, in one narrow pass: whole windows
    of a document are sequences, the remainder goes where the sum-of-squares rule says. A task holds at most
    ``most_open`` windows; beyond that, and at its end, open windows are cut and refilled, the last ones to powers of
    two, so that no sequence needs padding. Sequence ids are unique over all tasks, not consecutive.

    Which documents share a sequence follows from how the rows are dealt to tasks; a task that runs again packs the
    same, since rows of a file come in the same order.

    Defined cases: a null text is empty, and an empty text is ``end_id`` alone; null ids and repeated rows are packed
    like others; a document of any length is cut; an empty table gives an empty result; further columns are ignored.
    ``tokenizer_path`` must exist on every executor.
    """
    if size < 1 or size & (size - 1):
        raise ValueError(f"the window size must be a power of two, not {size}")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(
        lambda it: _pack_batches(it, tokenizer_path, size, end_id, most_open),
        f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return out.withColumnRenamed("id", id_col)
