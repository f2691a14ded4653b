"""The driver tables seen as the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.registry import table

#: The same relation in SQL, for the oracles.
NODES_SQL = """
nodes AS (
  SELECT NULL::VARCHAR AS parent_id, 'r.' || r_regionkey AS id, 'r.' || r_regionkey AS scope_id, []::VARCHAR[] AS ancestor_ids, r_regionkey::BIGINT AS sibling_order,
         0 AS depth, 'slide' AS role, 'section' AS element, ['region'] AS classes, r_name AS text, r_regionkey % 5 = 4 AS hidden FROM region
  UNION ALL
  SELECT 'r.' || n_regionkey, 'n.' || n_nationkey, 'r.' || n_regionkey, ['r.' || n_regionkey], n_nationkey, 1, 'group', 'g', ['nation'], n_name, n_regionkey % 5 = 4 FROM nation
  UNION ALL
  SELECT 'n.' || c_nationkey, 'c.' || c_custkey, 'r.' || n_regionkey, ['r.' || n_regionkey, 'n.' || c_nationkey], c_custkey, 2, 'shape', 'rect', ['customer', lower(c_mktsegment)], c_name, n_regionkey % 5 = 4
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'c.' || o_custkey, 'o.' || o_orderkey, 'r.' || n_regionkey, ['r.' || n_regionkey, 'n.' || c_nationkey, 'c.' || o_custkey], o_orderkey, 3, 'text', 'text', ['order', lower(o_orderstatus)], o_orderpriority, n_regionkey % 5 = 4
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer > order as an object tree; joins of fixed depth give the ancestors."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    r, n, c, o = (_name(p, k) for p, k in (("r.", "r_regionkey"), ("n.", "n_nationkey"), ("c.", "c_custkey"), ("o.", "o_orderkey")))
    rn, nc, co = _name("r.", "n_regionkey"), _name("n.", "c_nationkey"), _name("c.", "o_custkey")
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    dated = orders.join(placed, F.col("o_custkey") == F.col("c_custkey"))

    def level(df, parent, own, scope, above, order, depth, role, element, classes, text, region_key):
        return df.select(
            parent.alias("parent_id"), own.alias("id"), scope.alias("scope_id"), above.alias("ancestor_ids"), F.col(order).cast("long").alias("sibling_order"), F.lit(depth).alias("depth"),
            F.lit(role).alias("role"), F.lit(element).alias("element"), F.array(*classes).alias("classes"), F.col(text).alias("text"), (F.col(region_key) % 5 == 4).alias("hidden"),
        )

    return (
        level(region, F.lit(None).cast("string"), r, r, F.array().cast("array<string>"), "r_regionkey", 0, "slide", "section", [F.lit("region")], "r_name", "r_regionkey")
        .unionByName(level(nation, rn, n, rn, F.array(rn), "n_nationkey", 1, "group", "g", [F.lit("nation")], "n_name", "n_regionkey"))
        .unionByName(level(placed, nc, c, rn, F.array(rn, nc), "c_custkey", 2, "shape", "rect", [F.lit("customer"), F.lower("c_mktsegment")], "c_name", "n_regionkey"))
        .unionByName(level(dated, co, o, rn, F.array(rn, nc, co), "o_orderkey", 3, "text", "text", [F.lit("order"), F.lower("o_orderstatus")], "o_orderpriority", "n_regionkey"))
    )


SNAPSHOT_SQL = """
lefts AS (SELECT o_orderkey AS id, o_custkey AS parent_id, o_orderpriority AS text, CAST(round(o_totalprice * 100) AS BIGINT) AS geometry, o_orderstatus AS style, o_orderkey % 7 AS meta
          FROM orders WHERE o_orderkey % 11 <> 3),
rights AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 5 THEN o_custkey + 1 ELSE o_custkey END AS parent_id, CASE WHEN o_orderkey % 23 = 1 THEN NULL ELSE o_orderpriority END AS text,
           CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 13 = 2 THEN 500 ELSE 0 END AS geometry, CASE WHEN o_orderkey % 17 = 4 THEN 'X' ELSE o_orderstatus END AS style,
           CASE WHEN o_orderkey % 29 = 6 THEN 99 ELSE o_orderkey % 7 END AS meta FROM orders WHERE o_orderkey % 11 <> 8)"""


def order_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders with some dropped, added, moved, retitled, resized, restyled and relabelled."""
    orders = table(spark, sf_dir, "orders")
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    left = orders.where("o_orderkey % 11 <> 3").selectExpr("o_orderkey AS id", "o_custkey AS parent_id", "o_orderpriority AS text", f"{cents} AS geometry", "o_orderstatus AS style", "o_orderkey % 7 AS meta")
    right = orders.where("o_orderkey % 11 <> 8").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 19 = 5 THEN o_custkey + 1 ELSE o_custkey END AS parent_id", "CASE WHEN o_orderkey % 23 = 1 THEN NULL ELSE o_orderpriority END AS text",
        f"{cents} + CASE WHEN o_orderkey % 13 = 2 THEN 500 ELSE 0 END AS geometry", "CASE WHEN o_orderkey % 17 = 4 THEN 'X' ELSE o_orderstatus END AS style", "CASE WHEN o_orderkey % 29 = 6 THEN 99 ELSE o_orderkey % 7 END AS meta",
    )
    return left, right
