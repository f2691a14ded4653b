"""Values of one key laid end to end in an order, where a key may have any share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.workspace import Workspace

#: A binary value of more bytes cannot be put in hexadecimal on the way to its key's others.
MOST_BYTES = 1 << 30


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key and task; the keys at both ends of a task may go on in the tasks beside it."""
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    key, held, size, first, kind = None, [], 0, True, None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [kind, pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "part", "edge", "n", "value"])

    def close(edge: bool) -> None:
        nonlocal size
        if size > MOST_BYTES:
            raise OverflowError(f"the values of one key have {size} bytes, over the {MOST_BYTES} that one row can hold")
        rows.append((key, part, edge, len(held), b"".join(held)))
        held.clear()
        size = 0

    for batch in batches:
        kind = batch.column("key").type
        for k, v in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if k != key and held:
                close(first)
                first = False
            key = k
            held.append(v)
            size += len(v)
        if len(rows) > 1 << 12:
            yield flush()
    if held:
        close(True)
    if kind is not None:
        yield flush()


def laid_runs(ws: Workspace, name: str, rows: DataFrame, order: list[str], tasks: int) -> DataFrame:
    """From (key, value, order columns): (key, part, edge, n, value), pieces of each key's values in order.

    Rows are dealt by ranges of key and order, so a frequent key has many tasks and one piece in each. Only keys at the
    ends of a task (``edge``) have several pieces, in the order of ``part``.
    """
    kind = rows.schema["key"].dataType.simpleString()
    ranged = rows.repartitionByRange(tasks, "key", *order).sortWithinPartitions("key", *order).select("key", "value")
    return ws.table(name, ranged.mapInArrow(_lay, f"key {kind}, part int, edge boolean, n long, value binary"))


def whole_runs(pieces: DataFrame) -> DataFrame:
    """(key, n, value): one row a key."""
    joined: Column = F.expr("unhex(array_join(transform(array_sort(collect_list(struct(part, value))), p -> hex(p.value)), ''))")
    cut = pieces.where("edge").groupBy("key").agg(F.sum("n").alias("n"), joined.alias("value"))
    return pieces.where("NOT edge").select("key", "n", "value").unionByName(cut)
