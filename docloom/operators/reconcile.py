"""Reconciling an edited snapshot with its baseline: typed operations, findings and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How findings rank.
DISPOSITIONS = {"auto-fixable": 1, "review": 2, "refused": 3}
EFFECTS = {"none": 0, "normalisation": 10, "source-change": 20}


def candidate_operations(baseline: DataFrame, edited: DataFrame, operations: dict[str, str], key: str = "id") -> DataFrame:
    """(id, op, old, new): for objects on both sides, the operation that carries each changed field over."""
    names = list(operations)
    b = baseline.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in names])
    e = edited.select(key, *[F.col(c).cast("string").alias(f"e_{c}") for c in names])
    each = F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"b_{c}").alias("old"), F.col(f"e_{c}").alias("new")) for c, op in operations.items()])
    return b.join(e, key).select(key, F.explode(F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))).alias("o")).select(key, "o.*")


def child_orders(nodes: DataFrame, key: str = "id", parent: str = "parent_id", order: str = "sibling_order") -> DataFrame:
    return nodes.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key]).alias("children"))


def reordered_parents(baseline: DataFrame, edited: DataFrame, key: str = "id", parent: str = "parent_id", order: str = "sibling_order") -> DataFrame:
    """(parent_id, old, new): parents whose children that both sides have stand in another order."""
    return reordered(baseline.select(parent, key, F.col(order).alias("_old")).join(edited.select(parent, key, F.col(order).alias("_new")), [parent, key]), key, parent)


def reordered(both: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """``reordered_parents`` of children that have met already, with their places ``_old`` and ``_new``."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, key))), lambda x: x[key])
    return both.groupBy(parent).agg(ordered("_old").alias("old"), ordered("_new").alias("new")).where("old <> new")


def findings(changes: DataFrame, disposition, effect) -> DataFrame:
    """Adds disposition, effect, rank and an id from a hash of what the finding says."""
    map_of = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    out = changes.withColumn("disposition", disposition).withColumn("effect", effect)
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in changes.columns])
    rank = map_of(DISPOSITIONS)[F.col("disposition")] + map_of(EFFECTS)[F.col("effect")]
    return out.withColumn("rank", rank).withColumn("finding_id", F.concat(F.lit("finding."), F.left(F.sha2(said, 256), F.lit(16))))


def status(found: DataFrame, *by: str) -> DataFrame:
    """One row, or one of each value of ``by``: counts by disposition and effect, the highest disposition, and refused > review-required > patchable > unchanged."""
    n = {d: F.count_if(F.col("disposition") == d) for d in DISPOSITIONS}
    out = found.groupBy(*by).agg(
        *[v.alias(f"n_{d.replace('-', '_')}") for d, v in n.items()], *[F.count_if(F.col("effect") == e).alias(f"n_{e.replace('-', '_')}") for e in EFFECTS],
        F.max_by("disposition", F.create_map(*[F.lit(x) for p in DISPOSITIONS.items() for x in p])[F.col("disposition")]).alias("highest"),
    )
    return out.withColumn("status", F.when(F.col("n_refused") > 0, "refused").when(F.col("n_review") > 0, "review-required").when(F.col("n_auto_fixable") > 0, "patchable").otherwise("unchanged"))


def occurrences_by(found: DataFrame, by: str, refused: Column, occurrences: Column) -> DataFrame:
    """(by, n_refused, n_auto, occurrences): findings by disposition, and how often the refused ones occur."""
    n = F.coalesce(F.sum(F.when(refused, occurrences)), F.lit(0)).cast("long")
    return found.groupBy(by).agg(F.count_if(refused).alias("n_refused"), F.count_if(~refused).alias("n_auto"), n.alias("occurrences"))


def highest(found: DataFrame, by: str, value: str, *rank: str) -> DataFrame:
    """(by, top): the value of the highest rank of each group."""
    return found.groupBy(by).agg(F.max_by(value, F.struct(*rank)).alias("top"))


def reconcile(baseline: DataFrame, edited: DataFrame, operations: dict[str, str], review: tuple[str, ...] = (), key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, findings, status) that turn a baseline snapshot into an edited one.

    Every changed field with an operation is a candidate; those named in ``review`` need a look. Objects on one side
    only have no operation: each is a refused finding. Both sides have one row an id.
    """
    ops = candidate_operations(baseline, edited, operations, key)
    gone = baseline.select(key).join(edited.select(key), key, "left_anti").select(key, F.lit("object-missing").alias("op"))
    new = edited.select(key).join(baseline.select(key), key, "left_anti").select(key, F.lit("object-new").alias("op"))
    changes = ops.unionByName(gone.unionByName(new), allowMissingColumns=True)
    disposition = F.when(F.col("op").isin("object-missing", "object-new"), "refused").when(F.col("op").isin(*review), "review").otherwise("auto-fixable")
    found = findings(changes, disposition, F.lit("source-change"))
    return ops, found, status(found)


def unproven(baseline: DataFrame, edited: DataFrame, operations: dict[str, str], key: str = "id", ops: DataFrame | None = None) -> DataFrame:
    """(id, field, wanted, got): what still differs from the edited snapshot after operations (id, op, old, new) are applied
    to the baseline; the candidate operations if none are given. Empty if the operations say all that was changed."""
    ops = candidate_operations(baseline, edited, operations, key) if ops is None else ops
    after = baseline.select(key, *operations)
    for field, op in operations.items():
        news = ops.where(F.col("op") == op).select(key, F.col("new").alias("_new"), F.lit(True).alias("_hit"))
        after = after.join(news, key, "left").withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field).cast("string"))).drop("_new", "_hit")
    a = after.unpivot([key], list(operations), "field", "got")
    e = edited.select(key, *[F.col(c).cast("string").alias(c) for c in operations]).unpivot([key], list(operations), "field", "wanted")
    return e.join(a, [key, "field"]).where("NOT wanted <=> got").select(key, "field", "wanted", "got")
