"""An edit log with preconditions: every operation carries the value it expects, and applies only if it holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The operations that set one field of an object.
SETTERS = {"set-text": "text", "set-object-geometry": "geometry", "set-native-style": "style", "set-group-translation": "transform", "set-text-frame": "frame", "set-connector-endpoints": "relationship", "set-active-theme": "active_theme"}


def check_operations(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Each operation (seq, op, id, old, new) with a verdict: ok, unsupported, unknown-target, stale-value or conflicting.

    Two operations on one field of one object conflict; both are refused.
    """
    values = F.create_map(*[x for k, c in SETTERS.items() if c in nodes.columns for x in (F.lit(k), F.col(c).cast("string"))])
    state = nodes.select("id", values.alias("_now"), F.lit(True).alias("_there"))
    same = F.count("*").over(Window.partitionBy("id", "op"))
    out = ops.withColumn("_same", same).join(state, "id", "left")
    verdict = (
        F.when(~F.col("op").isin(*[k for k, c in SETTERS.items() if c in nodes.columns]), "unsupported")
        .when(F.col("_there").isNull(), "unknown-target")
        .when(F.col("_same") > 1, "conflicting")
        .when(~F.col("old").eqNullSafe(F.col("_now")[F.col("op")]), "stale-value")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict).drop("_same", "_now", "_there")


def apply_operations(nodes: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes after, checked operations). One refused operation withholds the whole log: nodes stay as they were."""
    checked = check_operations(nodes, ops)
    gate = checked.agg(F.coalesce(F.bool_and(F.col("verdict") == "ok"), F.lit(True)).alias("_all"))
    news = checked.where("verdict = 'ok'").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("op", F.struct("new").alias("v")))).alias("_set"))
    out = nodes.join(news, "id", "left").crossJoin(F.broadcast(gate))
    for op, column in SETTERS.items():
        if column in nodes.columns:
            hit = F.coalesce(F.col("_all") & F.map_contains_key("_set", F.lit(op)), F.lit(False))
            out = out.withColumn(column, F.when(hit, F.col("_set")[op]["new"].cast(nodes.schema[column].dataType)).otherwise(F.col(column)))
    return out.select(*nodes.columns), checked


def is_permutation(a, b):
    """The same values as often each."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def delete_subtrees(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes without the given ones and all that is below them."""
    gone = ids.select("id").distinct()
    below = nodes.select("id", F.explode("ancestor_ids").alias("_a")).join(gone.select(F.col("id").alias("_a")), "_a", "left_semi").select("id").distinct()
    return nodes.join(gone.unionByName(below).distinct(), "id", "left_anti")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sessions in order of session and seq; only the values that can still be undone or redone are held."""
    now, past, future, out = None, [], [], []

    def ended() -> dict:
        return {"session": now, "value": past[-1] if past else None, "depth": len(past), "undone": len(future)}

    begun = False
    for batch in batches:
        for session, action, value in zip(batch["session"], batch["action"], batch["value"], strict=True):
            if not begun or session != now:
                if begun:
                    out.append(ended())
                begun, now, past, future = True, session, [], []
            if action == "set":
                past.append(value)
                future.clear()
            elif action == "undo" and past:
                future.append(past.pop())
            elif action == "redo" and future:
                past.append(future.pop())
        yield pd.DataFrame(out, columns=["session", "value", "depth", "undone"])
        out.clear()
    if begun:
        yield pd.DataFrame([ended()])


def fold_sessions(events: DataFrame) -> DataFrame:
    """(session, value, depth, undone): sessions of events (session, seq, action, value) with undo and redo.

    A set drops what could be redone. Each session is read once, in order, as a stream of its partition; null sessions
    are none.
    """
    kind, of = (events.schema[c].dataType.simpleString() for c in ("session", "value"))
    ordered = events.where("session IS NOT NULL").select("session", "seq", "action", "value").repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(_fold, f"session {kind}, value {of}, depth int, undone int")


def clone_connectors(edges: DataFrame, clones: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the clones, checked clones). ``clones``: id, new_id, from_id, to_id; ``edges``: id, from_id, to_id, ...

    A clone takes its connector's other columns. It is refused as unknown-target, id-taken, conflicting (two clones of
    one new id) or unknown-endpoint; one refused clone withholds all.
    """
    taken = nodes.select("id").unionByName(edges.select("id")).distinct()
    has = lambda df, c, flag: df.select(F.col("id").alias(c), F.lit(True).alias(flag)).distinct()
    many = F.count("*").over(Window.partitionBy("new_id"))
    out = clones.withColumn("_n", many).join(has(edges, "id", "_edge"), "id", "left").join(has(taken, "new_id", "_taken"), "new_id", "left")
    out = out.join(has(nodes, "from_id", "_from"), "from_id", "left").join(has(nodes, "to_id", "_to"), "to_id", "left")
    verdict = (
        F.when(F.col("_edge").isNull(), "unknown-target").when(F.col("_taken"), "id-taken").when(F.col("_n") > 1, "conflicting")
        .when(F.col("_from").isNull() | F.col("_to").isNull(), "unknown-endpoint").otherwise("ok")
    )
    checked = out.select("id", "new_id", "from_id", "to_id", verdict.alias("verdict"))
    gate = checked.agg(F.coalesce(F.bool_and(F.col("verdict") == "ok"), F.lit(True)).alias("_all"))
    rest = [c for c in edges.columns if c not in ("id", "from_id", "to_id")]
    made = checked.where("verdict = 'ok'").join(edges.select("id", *rest), "id").select(F.col("new_id").alias("id"), "from_id", "to_id", *rest)
    return edges.unionByName(made.crossJoin(F.broadcast(gate)).where("_all").drop("_all").select(*edges.columns)), checked
