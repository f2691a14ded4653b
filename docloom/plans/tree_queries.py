"""Object queries, projections and snapshot diffs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import diff as D
from docloom.operators import integrity as I
from docloom.operators import objects as O
from docloom.plans.registry import query, table
from docloom.plans.relations import NODES_SQL, SNAPSHOT_SQL, order_snapshots, tree_nodes

WITH = f"WITH {NODES_SQL} "


@query("f1_list_objects", WITH + "SELECT scope_id, id, role, text FROM nodes WHERE role = 'text' AND list_contains(classes, 'o') AND contains(lower(text), lower('UrG')) AND scope_id = 'r.1'")
def f1_list_objects(spark, sf):
    return O.query_objects(tree_nodes(spark, sf), unique_ids=True, role="text", class_name="o", text_contains="UrG", slide_id="r.1")


@query("f2_query_by_ids_and_element", WITH + "SELECT scope_id, id, role, text, parent_id, sibling_order, depth, element, classes FROM nodes WHERE id IN ('c.1', 'c.7', 'o.9', 'n.3') AND element = 'rect'")
def f2_query_by_ids(spark, sf):
    return O.query_objects(tree_nodes(spark, sf), view="editing", unique_ids=True, ids=["c.1", "c.7", "o.9", "n.3"], element="rect")


@query("f3_descendants", WITH + "SELECT scope_id, id, role, text FROM nodes WHERE list_contains(ancestor_ids, 'n.7')")
def f3_descendants(spark, sf):
    return O.query_objects(tree_nodes(spark, sf), unique_ids=True, descendant_of="n.7")


@query("f4_ambiguity_suppression", WITH + ", doubled AS (SELECT * FROM nodes UNION ALL SELECT * FROM nodes WHERE depth = 2 AND sibling_order % 10 = 0) SELECT scope_id, id, role, text FROM doubled WHERE role = 'shape' AND id NOT IN (SELECT id FROM doubled GROUP BY id HAVING count(*) > 1)")
def f4_ambiguity(spark, sf):
    nodes = tree_nodes(spark, sf)
    return O.query_objects(nodes.unionByName(nodes.where("depth = 2 AND sibling_order % 10 = 0")), role="shape")


@query("p1_outline", "SELECT 'r.' || r_regionkey AS scope_id, r_regionkey::BIGINT AS slide_order, r_name AS title, r_regionkey % 5 = 4 AS hidden FROM region")
def p1_outline(spark, sf):
    """From the manifest alone: no object is read."""
    return table(spark, sf, "region").select(F.concat(F.lit("r."), F.col("r_regionkey").cast("string")).alias("scope_id"), F.col("r_regionkey").cast("long").alias("slide_order"), F.col("r_name").alias("title"), (F.col("r_regionkey") % 5 == 4).alias("hidden"))


@query("p3_inventory", WITH + "SELECT s.r_regionkey::BIGINT AS slide_order, n.scope_id, n.id, n.role, n.text, (SELECT count(*) FROM nodes c WHERE c.parent_id = n.id) AS n_children FROM nodes n JOIN region s ON n.scope_id = 'r.' || s.r_regionkey")
def p3_inventory(spark, sf):
    return O.inventory(tree_nodes(spark, sf), p1_outline(spark, sf))


@query("p4_get_scope_editing_view", WITH + "SELECT scope_id, id, role, text, parent_id, sibling_order, depth, element, classes FROM nodes WHERE scope_id = 'r.2'")
def p4_scope(spark, sf):
    return O.project(tree_nodes(spark, sf).where("scope_id = 'r.2'"), "editing")


@query("p5_get_object", WITH + "SELECT scope_id, id, role, text FROM nodes WHERE id = 'c.42'")
def p5_get_object(spark, sf):
    return O.get_object(tree_nodes(spark, sf), "c.42")


@query("p6_extract_text", WITH + "SELECT scope_id, id, text FROM nodes WHERE role = 'text' AND text IS NOT NULL AND NOT hidden")
def p6_extract_text(spark, sf):
    return O.extract_text(tree_nodes(spark, sf))


@query("p7_extract_text_of_scope", WITH + "SELECT scope_id, id, text FROM nodes WHERE role = 'text' AND text IS NOT NULL AND scope_id = 'r.4'")
def p7_extract_text(spark, sf):
    return O.extract_text(tree_nodes(spark, sf), "r.4", include_hidden=True)


@query("p9_w3_preorder", WITH + "SELECT id, row_number() OVER (PARTITION BY scope_id ORDER BY ancestor_orders || [sibling_order])::INT AS preorder FROM (SELECT n.*, list_transform(ancestor_ids, lambda a: split_part(a, '.', 2)::BIGINT) AS ancestor_orders FROM nodes n)")
def p9_preorder(spark, sf):
    path = F.concat(F.transform("ancestor_ids", lambda a: F.element_at(F.split(a, "[.]"), 2).cast("long")), F.array("sibling_order"))
    return O.preorder(tree_nodes(spark, sf), path)


@query("f18_w2_renumber_after_prune", WITH + "SELECT id, (row_number() OVER (PARTITION BY scope_id, parent_id ORDER BY sibling_order, id) - 1)::INT AS new_order FROM nodes WHERE sibling_order % 4 <> 1")
def f18_renumber(spark, sf):
    return O.renumbered(tree_nodes(spark, sf), F.expr("sibling_order % 4 <> 1")).select("id", "new_order")


@query("j21_ancestor_closure_counts", WITH + "SELECT ancestor_id, count(*) AS n_descendants FROM (SELECT unnest(ancestor_ids) AS ancestor_id FROM nodes) GROUP BY ALL")
def j21_closure(spark, sf):
    return O.closure(tree_nodes(spark, sf)).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"))


@query("a10_w15_first_of_duplicates", "SELECT key, id FROM (SELECT o_custkey AS key, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def a10_first(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey AS key", "o_orderkey AS id", "o_orderdate AS at")
    return O.first_of_each(rows, "key", ("at", "id")).select("key", "id")


FIELDS = {"parent_id": "reparented", "text": "text", "geometry": "geometry", "style": "style", "meta": "metadata"}
KINDS = ["added", "removed", *FIELDS.values()]
CHANGES_SQL = f"""WITH {SNAPSHOT_SQL}, j AS (SELECT coalesce(l.id, r.id) AS id, l.id AS lid, r.id AS rid, l.* EXCLUDE (id), r.parent_id AS parent_id2, r.text AS text2, r.geometry AS geometry2, r.style AS style2, r.meta AS meta2
  FROM lefts l FULL JOIN rights r ON l.id = r.id),
changes AS (
  SELECT id, CASE WHEN lid IS NULL THEN 'added' ELSE 'removed' END AS kind, '' AS field, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM j WHERE lid IS NULL OR rid IS NULL
  UNION ALL SELECT id, 'reparented', 'parent_id', parent_id::VARCHAR, parent_id2::VARCHAR FROM j WHERE lid IS NOT NULL AND rid IS NOT NULL AND parent_id IS DISTINCT FROM parent_id2
  UNION ALL SELECT id, 'text', 'text', text, text2 FROM j WHERE lid IS NOT NULL AND rid IS NOT NULL AND text IS DISTINCT FROM text2
  UNION ALL SELECT id, 'geometry', 'geometry', geometry::VARCHAR, geometry2::VARCHAR FROM j WHERE lid IS NOT NULL AND rid IS NOT NULL AND geometry IS DISTINCT FROM geometry2
  UNION ALL SELECT id, 'style', 'style', style, style2 FROM j WHERE lid IS NOT NULL AND rid IS NOT NULL AND style IS DISTINCT FROM style2
  UNION ALL SELECT id, 'metadata', 'meta', meta::VARCHAR, meta2::VARCHAR FROM j WHERE lid IS NOT NULL AND rid IS NOT NULL AND meta IS DISTINCT FROM meta2) """
COUNTS_SQL = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)


def _changes(spark, sf):
    return D.diff_snapshots(*order_snapshots(spark, sf), FIELDS)


@query("j1_diff_changes", CHANGES_SQL + "SELECT * FROM changes")
def j1_diff(spark, sf):
    return _changes(spark, sf)


@query("a1_diff_summary", CHANGES_SQL + f"SELECT {COUNTS_SQL}, count(*) AS total, count(DISTINCT id) AS changed_objects FROM changes")
def a1_summary(spark, sf):
    return D.summarize(_changes(spark, sf), KINDS)


@query("a6_o9_diff_classification", CHANGES_SQL + f"SELECT {COUNTS_SQL}, count(*) AS total, count(DISTINCT id) AS changed_objects, CASE WHEN count(*) > cap THEN 'incomparable' WHEN count(*) = 0 THEN 'exact' WHEN count(*) = count(*) FILTER (kind = 'metadata') THEN 'semantic-equivalent' ELSE 'changed' END AS classification FROM changes, (VALUES (100000), (10)) c(cap) GROUP BY cap")
def a6_classification(spark, sf):
    """All changes under the usual cap, and under one that they pass."""
    summary = D.summarize(_changes(spark, sf), KINDS)
    return D.classify(summary, ["metadata"]).unionByName(D.classify(summary, ["metadata"], most=10))


@query("a6_classified_objects", CHANGES_SQL + ", n AS (SELECT id, count(*) AS total, count(*) FILTER (kind = 'metadata') AS n_metadata FROM changes GROUP BY id) SELECT l.id, CASE WHEN n.id IS NULL THEN 'exact' WHEN n.total = n.n_metadata THEN 'semantic-equivalent' ELSE 'changed' END AS classification FROM lefts l LEFT JOIN n USING (id)")
def a6_objects(spark, sf):
    """Each object of the baseline by its own changes."""
    changes = _changes(spark, sf)
    counts = changes.groupBy("id").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "metadata").alias("n_metadata"))
    every = order_snapshots(spark, sf)[0].select("id").join(counts, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "n_metadata")})
    return D.classify(every, ["metadata"]).select("id", "classification")


@query("o1_ordered_changes", CHANGES_SQL + ", pos AS (SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY id)::INT AS traversal FROM lefts) SELECT c.*, coalesce(p.traversal, 0)::INT AS traversal, list_position(['added', 'removed', 'reparented', 'text', 'geometry', 'style', 'metadata'], kind)::INT AS kind_rank FROM changes c LEFT JOIN pos p USING (id)")
def o1_ordered(spark, sf):
    from pyspark.sql import Window

    left, _ = order_snapshots(spark, sf)
    traversal = left.select("id", F.row_number().over(Window.partitionBy("parent_id").orderBy("id")).alias("traversal"))
    return D.ordered_changes(_changes(spark, sf), traversal, {k: i + 1 for i, k in enumerate(KINDS)})


@query("x1_x2_id_set_operations", f"WITH {SNAPSHOT_SQL} SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM lefts UNION SELECT id FROM rights) UNION ALL SELECT 'left_only', count(*) FROM (SELECT id FROM lefts EXCEPT SELECT id FROM rights) UNION ALL SELECT 'right_only', count(*) FROM (SELECT id FROM rights EXCEPT SELECT id FROM lefts)")
def x1_sets(spark, sf):
    return I.id_sets(*order_snapshots(spark, sf))


@query("m16_three_way_merge", """WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0),
o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'A' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 1),
t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'A' WHEN o_orderkey % 10 = 4 THEN 'B' ELSE o_orderstatus END AS v FROM orders),
j AS (SELECT coalesce(b.id, o.id, t.id) AS id, b.id IS NOT NULL AS bh, o.id IS NOT NULL AS oh, t.id IS NOT NULL AS th, b.v AS bv, o.v AS ov, t.v AS tv FROM b FULL JOIN o ON b.id = o.id FULL JOIN t ON coalesce(b.id, o.id) = t.id),
k AS (SELECT *, (oh = bh AND ov IS NOT DISTINCT FROM bv) AS so, (th = bh AND tv IS NOT DISTINCT FROM bv) AS st, (oh = th AND ov IS NOT DISTINCT FROM tv) AS ag FROM j)
SELECT id, CASE WHEN so AND st THEN 'unchanged' WHEN ag THEN 'agreed' WHEN st THEN 'ours' WHEN so THEN 'theirs' ELSE 'conflict' END AS outcome,
 CASE WHEN so THEN tv WHEN st OR ag THEN ov END AS merged, CASE WHEN so THEN NOT th WHEN st OR ag THEN NOT oh ELSE false END AS deleted FROM k""")
def m16_merge(spark, sf):
    orders = table(spark, sf, "orders")
    base = orders.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS id", "o_orderstatus AS v")
    ours = orders.where("o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 1").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 4 = 0 THEN 'A' ELSE o_orderstatus END AS v")
    theirs = orders.selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 6 = 0 THEN 'A' WHEN o_orderkey % 10 = 4 THEN 'B' ELSE o_orderstatus END AS v")
    return D.three_way(base, ours, theirs, "v")


@query("m16_merged_lines", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 2 = 0 AS o, doc_id % 5 = 0 AS b, doc_id % 3 = 0 AS t, doc_id % 10 = 5 AS cut FROM documents)
SELECT doc_id, CASE WHEN o AND b THEN array_to_string(['<<<<<<< ours', '# ours', '||||||| base', '# head', '=======', '# theirs', '>>>>>>> theirs'], chr(10)) WHEN o THEN '# ours' WHEN b THEN '# theirs' ELSE '# head' END
  || chr(10) || text || chr(10) || CASE WHEN t THEN '# last' ELSE '# tail' END || CASE WHEN cut THEN chr(10) || '# same' ELSE '' END AS merged, CASE WHEN o AND b THEN 1 ELSE 0 END::INT AS conflicts FROM d""")
def m16_lines(spark, sf):
    """First lines that one side or both changed, last lines that theirs changed, lines that both added alike."""
    rows = table(spark, sf, "documents").selectExpr("doc_id", "coalesce(text, '') AS body", "CASE WHEN doc_id % 10 = 5 THEN '\\n# same' ELSE '' END AS more")
    side = lambda head, tail, more: F.concat(F.expr(head), F.lit("\n"), "body", F.lit("\n"), F.expr(tail), F.expr(more))
    last = "CASE WHEN doc_id % 3 = 0 THEN '# last' ELSE '# tail' END"
    theirs = side("CASE WHEN doc_id % 5 = 0 THEN '# theirs' ELSE '# head' END", last, "more")
    # Where both add lines at the end, both also change the last one: what touches and differs would be a conflict.
    ours = side("CASE WHEN doc_id % 2 = 0 THEN '# ours' ELSE '# head' END", f"CASE WHEN doc_id % 10 = 5 THEN {last} ELSE '# tail' END", "more")
    texts = rows.select("doc_id", side("'# head'", "'# tail'", "''").alias("base"), ours.alias("ours"), theirs.alias("theirs"))
    return D.merge_texts(texts, "base", "ours", "theirs").select("doc_id", "merged", "conflicts")
