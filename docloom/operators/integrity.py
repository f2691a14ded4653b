"""Reference integrity and repository checks: semi, anti and lookup joins, and conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_endpoints(edges: DataFrame, ids: DataFrame, ends: tuple[str, ...] = ("from_id", "to_id"), key: str = "id") -> DataFrame:
    """(edge key, end, missing_id): ends of edges that no id matches."""
    long = edges.unpivot([key], list(ends), "end", "missing_id")
    return long.join(ids.select(F.col(key).alias("missing_id")).distinct(), "missing_id", "left_anti").select(key, "end", "missing_id")


def topmost_missing(mapped: DataFrame, missing: DataFrame, key: str = "id") -> DataFrame:
    """Mapped objects that are missing though their parent is not."""
    gone = missing.select(key).distinct()
    return mapped.join(gone, key, "left_semi").join(gone.select(F.col(key).alias("parent_id")), "parent_id", "left_anti")


def deletion_hazards(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges that stay though an end is deleted."""
    gone = deleted.select("id").distinct()
    end = lambda name: gone.select(F.col("id").alias(name), F.lit(True).alias(f"{name}_gone"))
    touching = edges.join(end("from_id"), "from_id", "left").join(end("to_id"), "to_id", "left").where("from_id_gone OR to_id_gone")
    return touching.drop("from_id_gone", "to_id_gone").join(gone, "id", "left_anti")


def reference_counts(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Each reference with how many targets it has and a verdict: resolved, missing or ambiguous."""
    n = targets.groupBy(key).agg(F.count("*").alias("n_targets"))
    out = references.join(n, key, "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("n_targets") == 1, "resolved").when(F.col("n_targets") == 0, "missing").otherwise("ambiguous"))


def unused(targets: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return targets.join(references.select(key).distinct(), key, "left_anti")


def drift(documented: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """Documented against computed values: OK, DRIFT or NEW."""
    both = computed.select(key, F.col(value).alias("computed")).join(documented.select(key, F.col(value).alias("documented")), key, "left")
    return both.withColumn("state", F.when(F.col("documented").isNull(), "NEW").when(F.col("documented") == F.col("computed"), "OK").otherwise("DRIFT"))


def overlapping(ranges: DataFrame, scope: str, start: str = "start", end: str = "end", ties: tuple[str, ...] = ()) -> DataFrame:
    """Ranges that begin before their predecessor (by start, end, then ``ties``) ends; equal empty ranges collide too."""
    order = Window.partitionBy(scope).orderBy(start, end, *ties)
    before, at = F.lag(end).over(order), F.lag(start).over(order)
    clash = (before > F.col(start)) | ((at == F.col(start)) & (F.col(start) == F.col(end)) & (before == F.col(start)))
    return ranges.withColumn("_clash", clash).where("_clash").drop("_clash")


def contained(inner: DataFrame, outer: DataFrame, scope: str) -> DataFrame:
    """Inner ranges that some outer range of their scope holds.

    Both sides are sorted together by their starts: of the outer ranges that begin no later, the one that reaches furthest
    decides. One sort, whatever a scope's number of ranges.
    """
    both = inner.withColumn("_reach", F.lit(None).cast(outer.schema["end"].dataType)).withColumn("_inner", F.lit(1))
    both = both.unionByName(outer.select(scope, F.col("start"), F.col("end").alias("_reach"), F.lit(0).alias("_inner")), allowMissingColumns=True)
    furthest = F.max("_reach").over(Window.partitionBy(scope).orderBy("start", "_inner").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_furthest", furthest).where(f"_inner = 1 AND `{scope}` IS NOT NULL AND end <= _furthest").select(*inner.columns)


def as_of(events: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each event with the last mark at or before it: one sort of both sides together, no range join."""
    both = events.select(*events.columns, F.lit(None).cast(marks.schema[value].dataType).alias("_v"), F.lit(1).alias("_e"))
    both = both.unionByName(marks.select(by, at, F.col(value).alias("_v"), F.lit(0).alias("_e")), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(by).orderBy(at, "_e").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("_e = 1").drop("_v", "_e")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by the order."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def next_free(used: DataFrame, column: str) -> DataFrame:
    """The number after the largest, and the smallest positive number not in use.

    The smallest is 1, or follows a number in use whose successor is free: an anti join, no ordered pass.
    """
    n = used.select(F.col(column).cast("long").alias("n")).where("n > 0").distinct()
    ends = n.join(n.select((F.col("n") - 1).alias("n")), "n", "left_anti").agg((F.min("n") + 1).alias("after"))
    return n.agg(F.coalesce(F.max("n") + 1, F.lit(1)).alias("after_last"), F.min("n").alias("least")).crossJoin(ends).select(
        "after_last", F.when(F.col("least") == 1, F.col("after")).otherwise(F.lit(1)).cast("long").alias("smallest_free")
    )


def run_lengths(rows: DataFrame, scope: str, order: str, value: Column) -> DataFrame:
    """Maximal runs of an equal value: (scope, run, value, first, last, size)."""
    by = Window.partitionBy(scope).orderBy(order)
    new = F.coalesce((~F.lag("_v").over(by).eqNullSafe(F.col("_v"))) | F.lag(order).over(by).isNull(), F.lit(True))
    numbered = rows.withColumn("_v", value).withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(by))
    return numbered.groupBy(scope, "run").agg(F.first("_v").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, columns): rows that one side has more often than the other, as often as that."""
    return left.exceptAll(right).select(F.lit("left").alias("side"), *left.columns).unionByName(right.exceptAll(left).select(F.lit("right").alias("side"), *left.columns))


def id_sets(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(op, n): how many ids the union and both differences have; one shuffle of the ids answers all."""
    side = lambda df, l, r: df.select(key, F.lit(l).alias("l"), F.lit(r).alias("r"))
    sides = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    one = sides.agg(F.count("*").alias("union"), F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"))
    return one.unpivot([], ["union", "left_only", "right_only"], "op", "n")


def three_way_map(source: DataFrame, resolved: DataFrame, composed: DataFrame, key: str = "id") -> DataFrame:
    """(key, n_source, n_resolved, n_composed, verdict) of every key of any side: mapped if each side has it once."""
    sides = {"source": source, "resolved": resolved, "composed": composed}
    long = None
    for name, df in sides.items():
        part = df.select(key, *[F.lit(int(n == name)).alias(f"n_{n}") for n in sides])
        long = part if long is None else long.unionByName(part)
    out = long.groupBy(key).agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in sides])
    least, most = (f(*[F.col(f"n_{n}") for n in sides]) for f in (F.least, F.greatest))
    return out.withColumn("verdict", F.when(least == 0, "missing").when(most > 1, "duplicate").otherwise("mapped"))


def out_of_order(rows: DataFrame, scope: str, order: str, rank: str) -> DataFrame:
    """Rows whose rank is below that of some row before them."""
    high = F.max(rank).over(Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_high", high).where(F.col("_high") > F.col(rank)).drop("_high")


def contiguous(rows: DataFrame, scope: str, order: str) -> DataFrame:
    """(scope, contiguous): whether the order numbers are 1..n. Distinct positive numbers are so exactly if their count
    is their maximum: an aggregate, no window."""
    return rows.groupBy(scope).agg(((F.max(order) == F.count("*")) & (F.count_distinct(order) == F.count("*")) & (F.min(order) == 1)).alias("contiguous"))


def output_ranges(edits: DataFrame, scope: str, order: tuple[str, ...], start: str, delta: str) -> DataFrame:
    """Adds out_start: where each edit's start is after all earlier edits of its scope have changed the length."""
    before = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("out_start", F.col(start) + F.coalesce(F.sum(delta).over(before), F.lit(0)))


def nth_in_a_row(rows: DataFrame, scope: str, order: tuple[str, ...], value: str, n: int = 3) -> DataFrame:
    """The rows that are the n-th of equal observations in a row."""
    by = Window.partitionBy(scope).orderBy(*order)
    new = (~F.lag(value).over(by).eqNullSafe(F.col(value))) | (F.row_number().over(by) == 1)
    numbered = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(by))
    return numbered.withColumn("_n", F.row_number().over(Window.partitionBy(scope, "_run").orderBy(*order))).where(F.col("_n") == n).drop("_new", "_run", "_n")


def occurrence_status(ids: DataFrame, occurrences: DataFrame, key: str) -> DataFrame:
    """(key, n, status): how often each id occurs: missing, unique or duplicate."""
    n = occurrences.groupBy(key).agg(F.count("*").alias("n"))
    out = ids.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "unique").otherwise("duplicate"))


def grouped_ids(rows: DataFrame, by: tuple[str, ...], key: str) -> DataFrame:
    """(by, ids, n): the ids of each group in order, as text."""
    ids = F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string"))
    return rows.groupBy(*by).agg(F.array_join(ids, ",").alias("ids"), F.count("*").alias("n"))


def newest(rows: DataFrame, key: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The last n rows of each key. The limit is the feature; Spark prunes each map side to n a key."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def first_match(rows: DataFrame, key: str, order: str, value: str, condition: str) -> DataFrame:
    """(key, value) of the first row of each key that meets the condition."""
    return rows.where(condition).groupBy(key).agg(F.min_by(value, order).alias(value))


def has_all(rows: DataFrame, key: str, value: str, required: tuple[str, ...]) -> DataFrame:
    """(key, has_all): whether each key has every required value."""
    return rows.groupBy(key).agg((F.size(F.array_except(F.array(*map(F.lit, required)), F.collect_set(value))) == 0).alias("has_all"))


def unseen(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Keys that the ledger of what was seen lacks, once each."""
    return rows.select(key).distinct().join(ledger.select(key).distinct(), key, "left_anti")


def fingerprint_groups(rows: DataFrame, fingerprint: Column, key: str, size: int) -> DataFrame:
    """(fingerprint, n, baseline): fingerprints that exactly ``size`` rows have, with the smallest key of each."""
    return rows.groupBy(fingerprint.alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("baseline")).where(F.col("n") == size)


def alias_pairs(rows: DataFrame, key: str, canonical: Column) -> DataFrame:
    """(a, b), a < b: each key with the smallest key of its canonical form, which stands for all of that form.

    Two keys are aliases exactly if they have one representative; a form of n keys gives n - 1 rows, not all pairs.
    """
    r = rows.select(key, canonical.alias("_canonical")).where("_canonical IS NOT NULL")
    first = r.groupBy("_canonical").agg(F.min(key).alias("a"))
    return r.withColumnRenamed(key, "b").join(first, "_canonical").where("a < b").select("a", "b").distinct()
