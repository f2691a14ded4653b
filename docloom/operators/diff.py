"""Snapshot diff: a full outer join on a stable id, one row for each changed field group, and its summary."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Fixed value: characters of merged text that a task holds before rows leave it.
BATCH_CHARS = 4 << 20


def diff_snapshots(left: DataFrame, right: DataFrame, fields: dict[str, str], key: str = "id") -> DataFrame:
    """(key, kind, field, old_value, new_value): objects added or removed, and each compared field that changed.

    ``fields`` maps a field to the kind of change it makes. Nulls are equal to nulls. Each side is one row an id.
    """
    names = list(fields)
    l = left.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias("l"))
    r = right.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias("r"))
    both = l.join(r, key, "full_outer")
    null = F.lit(None).cast("string")
    side = F.struct(F.when(F.col("l").isNull(), "added").otherwise("removed").alias("kind"), F.lit("").alias("field"), null.alias("old_value"), null.alias("new_value"))
    each = [F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("field"), F.col(f"l.{c}").alias("old_value"), F.col(f"r.{c}").alias("new_value")) for c, kind in fields.items()]
    changed = F.filter(F.array(*each), lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    rows = F.when(F.col("l").isNull() | F.col("r").isNull(), F.array(side)).otherwise(changed)
    return both.select(key, F.explode(rows).alias("c")).select(key, "c.*")


def summarize(changes: DataFrame, kinds: list[str], key: str = "id") -> DataFrame:
    """Changes by kind, all changes, and distinct changed objects: one row."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    return changes.agg(*counts, F.count("*").alias("total"), F.count_distinct(key).alias("changed_objects"))


def classify(summary: DataFrame, neutral: list[str], most: int = 100_000) -> DataFrame:
    """exact without changes, semantic-equivalent if only neutral kinds changed, else changed; incomparable beyond the cap.

    A report over the cap is refused as a whole, never cut.
    """
    quiet = sum((F.col(f"n_{k}") for k in neutral), F.lit(0))
    label = F.when(F.col("total") > most, "incomparable").when(F.col("total") == 0, "exact").when(F.col("total") == quiet, "semantic-equivalent").otherwise("changed")
    return summary.withColumn("classification", label)


def ordered_changes(changes: DataFrame, traversal: DataFrame, ranks: dict[str, int], key: str = "id") -> DataFrame:
    """Adds each change's sort keys: the object's traversal number (0 if unknown) and its kind's rank."""
    rank = F.create_map(*[F.lit(x) for p in ranks.items() for x in p])[F.col("kind")]
    return changes.join(traversal, key, "left").withColumn("traversal", F.coalesce("traversal", F.lit(0))).withColumn("kind_rank", rank)


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, value: str, key: str = "id") -> DataFrame:
    """(key, outcome, merged): row-level merge; a side that kept the base gives way, equal changes agree, others conflict."""
    b, o, t = (d.select(key, F.struct(F.col(value).alias("v")).alias(n)) for d, n in ((base, "b"), (ours, "o"), (theirs, "t")))
    all3 = b.join(o, key, "full_outer").join(t, key, "full_outer")
    same_o, same_t, agree = (F.col(x).eqNullSafe(F.col(y)) for x, y in (("o", "b"), ("t", "b"), ("o", "t")))
    outcome = F.when(same_o & same_t, "unchanged").when(agree, "agreed").when(same_t, "ours").when(same_o, "theirs").otherwise("conflict")
    merged = F.when(same_o, F.col("t.v")).when(same_t | agree, F.col("o.v"))
    gone = F.when(same_o, F.col("t").isNull()).when(same_t | agree, F.col("o").isNull()).otherwise(False)
    return all3.select(key, outcome.alias("outcome"), merged.alias("merged"), gone.alias("deleted"))


def _merge_lines(base: list[str], ours: list[str], theirs: list[str]) -> tuple[list[str], int]:
    """Merged lines, and how many stretches of the base both sides changed in different ways."""
    edits = []
    for k, side in enumerate((ours, theirs)):
        changed = [op for op in SequenceMatcher(None, base, side, autojunk=False).get_opcodes() if op[0] != "equal"]
        edits += [(low, high, k, start, end) for _, low, high, start, end in changed]
    sides, shift = (ours, theirs), [0, 0]
    out, conflicts, at = [], 0, 0
    edits.sort()
    while edits:
        low, high = edits[0][:2]
        group = [edits.pop(0)]
        while edits and edits[0][0] <= high:
            group.append(edits.pop(0))
            high = max(high, group[-1][1])
        new = []
        for k in (0, 1):
            first = low + shift[k]
            shift[k] += sum((end - start) - (h - l) for l, h, side, start, end in group if side == k)
            new.append(sides[k][first : high + shift[k]])
        out += base[at:low]
        touched = {e[2] for e in group}
        if len(touched) == 1:
            out += new[touched.pop()]
        elif new[0] == new[1]:
            out += new[0]
        else:
            conflicts += 1
            out += ["<<<<<<< ours", *new[0], "||||||| base", *base[low:high], "=======", *new[1], ">>>>>>> theirs"]
        at = high
    return out + base[at:], conflicts


def _merged(batches: Iterator[pa.RecordBatch], places: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Rows with their merge. Texts are read one row at a time, and rows leave when enough text is held."""
    for batch in batches:
        texts, done, size = [batch.column(k) for k in places], [], 0
        for row in range(1, batch.num_rows + 1):
            lines, n = _merge_lines(*((c[row - 1].as_py() or "").split("\n") for c in texts))
            done.append(("\n".join(lines), n))
            size += len(done[-1][0])
            if size > BATCH_CHARS or row == batch.num_rows:
                own = batch.slice(row - len(done), len(done)).columns
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32()), strict=True))], names=[*batch.schema.names, "merged", "conflicts"])
                done, size = [], 0


def merge_texts(rows: DataFrame, base: str, ours: str, theirs: str) -> DataFrame:
    """Adds merged (text) and conflicts (int): a three-way merge of lines, in the row that holds the three texts.

    Changes of one side are taken, equal changes once; changes that touch and differ stand between markers with the base.
    Null is an empty text, and a side that equals the base or the other side costs no comparison of lines.
    """
    b, o, t = (F.coalesce(F.col(c), F.lit("")) for c in (base, ours, theirs))
    places = tuple(rows.columns.index(c) for c in (base, ours, theirs))
    easy = F.when((o == b) | (o == t), t).when(t == b, o)
    kinds = StructType([*rows.schema.fields, StructField("merged", StringType()), StructField("conflicts", IntegerType())])
    hard = rows.where(easy.isNull()).mapInArrow(lambda batches: _merged(batches, places), kinds)
    return rows.where(easy.isNotNull()).withColumn("merged", easy).withColumn("conflicts", F.lit(0)).unionByName(hard)
