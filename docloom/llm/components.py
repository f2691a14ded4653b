"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return down.join(least, "u").select(ends.alias("e")).select("e.u", "e.v").where("u <> v")


#: Edges a task writes at most, about, where the cluster's cores do not ask for more tasks.
EDGES_A_TASK = 1_000_000


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; the number of edges comes first."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def contract(edges: DataFrame, workspace: Workspace, name: str, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), v < u, of a graph with the same components, after large-star and small-star rounds.

    Without ``rounds`` it goes on until nothing changes: then every u has one v, the smallest node it can reach.
    Each half round is written to the shared folder, so none is ever recomputed. No group of neighbours is gathered:
    minima are pre-aggregated and joined back, and adaptive execution splits a centre with very many edges.
    """
    now = workspace.table(f"{name}-0", edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _mark(now)
    for k in range(1, 1 + (rounds or 100)):
        tasks = workspace.tasks(seen[0], EDGES_A_TASK)
        large = workspace.table(f"{name}-{k}-large", _large_star(now), tasks)
        now = workspace.table(f"{name}-{k}", _small_star(large).coalesce(tasks).distinct(), tasks)
        workspace.drop(f"{name}-{k}-large")
        workspace.drop(f"{name}-{k - 1}")
        mark = _mark(now)
        if mark == seen or k == rounds:
            return now
        seen = mark
    raise RuntimeError("the components did not settle")


def connected_components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Returns (node, root): every node of the undirected edges (u, v) with the smallest node it can reach."""
    stars = contract(edges, workspace, name)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
