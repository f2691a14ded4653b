"""Queries and projections over an object tree held as an adjacency list.

Columns of ``nodes``: scope_id, id, parent_id, ancestor_ids, sibling_order, depth, role, element, classes, text, hidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.shared_tables import SharedTables

SEMANTIC = ("scope_id", "id", "role", "text")
EDITING = (*SEMANTIC, "parent_id", "sibling_order", "depth", "element", "classes")


def project(nodes: DataFrame, view: str = "semantic") -> DataFrame:
    """The columns of a view: what an object means, or also how it is stored."""
    return nodes.select(*(SEMANTIC if view == "semantic" else EDITING))


def ambiguous_ids(nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """Ids that more than one object declares; they match no query."""
    keys = [scope, "id"] if scope else ["id"]
    return nodes.groupBy(*keys).count().where("count > 1").select(*keys)


def predicates(
    slide_id: str | None = None,
    ids: list[str] | None = None,
    role: str | None = None,
    class_name: str | None = None,
    element: str | None = None,
    text_contains: str | None = None,
    descendant_of: str | None = None,
) -> Column:
    """All given conditions together. Text is compared without case; an object is no descendant of itself."""
    tests = [F.lit(True)]
    if slide_id is not None:
        tests.append(F.col("scope_id") == slide_id)
    if ids is not None:
        tests.append(F.col("id").isin(ids))
    if role is not None:
        tests.append(F.col("role") == role)
    if class_name is not None:
        tests.append(F.array_contains("classes", class_name))
    if element is not None:
        tests.append(F.col("element") == element)
    if text_contains is not None:
        tests.append(F.coalesce(F.contains(F.lower("text"), F.lower(F.lit(text_contains))), F.lit(False)))
    if descendant_of is not None:
        tests.append(F.array_contains("ancestor_ids", descendant_of))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def query_objects(nodes: DataFrame, view: str = "semantic", unique_ids: bool = False, **conditions) -> DataFrame:
    """Objects that meet all conditions, in the columns of the view.

    Ids declared twice never match; ``unique_ids`` says that the source has none, which saves the check's shuffle.
    """
    found = nodes.where(predicates(**conditions))
    if not unique_ids:
        found = found.join(ambiguous_ids(nodes), "id", "left_anti")
    return project(found, view)


def get_object(nodes: DataFrame, object_id: str, view: str = "semantic") -> DataFrame:
    """The object with this id, or nothing if several have it."""
    return project(nodes.where(F.col("id") == object_id).withColumn("_n", F.count("*").over(Window.partitionBy("id"))).where("_n = 1"), view)


def extract_text(nodes: DataFrame, scope_id: str | None = None, include_hidden: bool = False) -> DataFrame:
    """Texts of text objects; hidden scopes are left out unless asked for or named."""
    found = nodes.where("role = 'text' AND text IS NOT NULL")
    if scope_id is not None:
        found = found.where(F.col("scope_id") == scope_id)
    if not include_hidden:
        found = found.where("NOT hidden")
    return found.select("scope_id", "id", "text")


def inventory(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Objects with the position of their scope in the manifest and the number of their children."""
    children = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    out = nodes.join(scopes.select("scope_id", "slide_order"), "scope_id").join(children, "id", "left")
    return out.select("slide_order", "scope_id", "id", "role", "text", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def renumbered(nodes: DataFrame, kept: Column, order_col: str = "sibling_order") -> DataFrame:
    """Drops what is not kept, then numbers siblings from 0 in their old order."""
    order = Window.partitionBy("scope_id", "parent_id").orderBy(order_col, "id")
    return nodes.where(kept).withColumn("new_order", (F.row_number().over(order) - 1).cast("int"))


def first_of_each(nodes: DataFrame, key: str = "id", order: tuple[str, ...] = ("depth", "sibling_order")) -> DataFrame:
    """Of several with one id, the first in traversal order."""
    return nodes.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, id): every object with each of its ancestors."""
    return nodes.select(F.explode("ancestor_ids").alias("ancestor_id"), "id")


def tree_paths(spark, nodes: DataFrame, max_depth: int = 512) -> DataFrame:
    """Ancestor ids of an adjacency list (id, parent_id), level by level, for trees small enough to recurse over."""
    if int(spark.conf.get("spark.sql.cteRecursionLevelLimit")) < max_depth:
        spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max_depth))
    return spark.sql(
        "WITH RECURSIVE t(id, ancestor_ids) AS (SELECT id, CAST(array() AS ARRAY<STRING>) FROM {nodes} WHERE parent_id IS NULL "
        "UNION ALL SELECT n.id, t.ancestor_ids || array(t.id) FROM {nodes} n JOIN t ON n.parent_id = t.id) SELECT * FROM t",
        nodes=nodes.select("id", "parent_id"),
    )


def ancestor_closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance) of an adjacency list (id, parent_id) that knows no ancestors, by pointer doubling.

    Every round joins what is known with the jumps of its length, so a tree of depth d takes log2(d) + 1 joins, not d. Each
    round is written, and the next reads it. Parents that are not in the list end a chain; ids may be of any type that
    can be joined. A cycle is an error that names one of its members.
    """
    tables = SharedTables(nodes.sparkSession, "closure")
    edges = nodes.select("id", F.col("parent_id").alias("ancestor_id")).join(nodes.select(F.col("id").alias("ancestor_id")).distinct(), "ancestor_id", "left_semi")
    known = tables.cut("known-0", edges.select("id", "ancestor_id", F.lit(1).alias("distance")))
    jumps, turn = known, 0
    while jumps.head(1):
        if around := known.where("id = ancestor_id").head(1):
            raise ValueError(f"{around[0].id} is an ancestor of itself")
        turn += 1
        step = jumps.select("id", F.col("ancestor_id").alias("via"), F.col("distance").alias("so_far"))
        longer = lambda rows, step=step: rows.withColumnRenamed("id", "via").join(step, "via").select("id", "ancestor_id", (F.col("so_far") + F.col("distance")).alias("distance"))
        more, jumps = tables.cut(f"more-{turn}", longer(known)), tables.cut(f"jumps-{turn}", longer(jumps))
        known = known.unionByName(more)
    return known


def chain_tops(nodes: DataFrame) -> DataFrame:
    """(id, top, distance) of an adjacency list (id, parent_id): the last ancestor of each object and how far up it stands.

    Pointers are doubled as in ``ancestor_closure``, but an object keeps only the farthest ancestor it knows: a round writes one row
    an object, not one a pair, so depth d costs log2(d) + 1 times the input. Objects whose parent is not in the list have no
    row. A cycle is an error that names one of its members.
    """
    tables = SharedTables(nodes.sparkSession, "tops")
    edges = nodes.select("id", F.col("parent_id").alias("top")).join(nodes.select(F.col("id").alias("top")).distinct(), "top", "left_semi")
    known = tables.cut("tops-0", edges.select("id", "top", F.lit(1).cast("long").alias("distance"), F.lit(False).alias("done")))
    most, turn = known.count(), 0
    while open_ := known.where("NOT done").head(1):
        if 2 ** (turn - 1) > most:
            raise ValueError(f"{open_[0].top} is an ancestor of itself")
        turn += 1
        beyond = known.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("distance").alias("_more"), F.col("done").alias("_done"))
        longer = known.where("NOT done").join(beyond, "top", "left").select("id", F.coalesce("_top", "top").alias("top"), (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance"), F.coalesce("_done", F.lit(True)).alias("done"))
        known = tables.cut(f"tops-{turn}", longer.unionByName(known.where("done")))
    return known.drop("done")


def preorder(nodes: DataFrame, path: Column, branch: int = 3) -> DataFrame:
    """(id, preorder): the place of each object in its scope, from 1, by its path of sibling orders.

    Objects are ranked within the subtree that the first steps of their path name, and the sizes of the subtrees before
    it are added, so no task holds a whole scope.
    """
    placed = nodes.select("scope_id", "id", path.alias("_path")).withColumn("_branch", F.slice("_path", 1, branch))
    sizes = placed.groupBy("scope_id", "_branch").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("scope_id").orderBy("_branch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("scope_id", "_branch", F.coalesce(before, F.lit(0)).alias("_before"))
    within = placed.withColumn("_k", F.row_number().over(Window.partitionBy("scope_id", "_branch").orderBy("_path")))
    return within.join(starts, ["scope_id", "_branch"]).select("id", (F.col("_before") + F.col("_k")).cast("int").alias("preorder"))
