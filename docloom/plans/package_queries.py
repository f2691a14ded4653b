"""Whole packages over the driver tables: decks compiled, read again, normalised and reconciled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import escape_xml
from docloom.operators import deck as D
from docloom.operators import normalise as N
from docloom.plans.registry import query, table
from docloom.plans.rule_cases import CASES, EXPECTED
from docloom.sources import packages as P
from docloom.sources import xml_tree as T
from docloom.sources.shared_tables import SharedTables

#: A deck a customer, a slide a remainder of the order key, a title and a shape an order on it; and the same edited.
DECKS_SQL = """
d AS (SELECT 'c' || o_custkey AS package, o_orderkey % 3 AS slide_order, o_orderkey AS k, 'o' || o_orderkey AS id, ['rect', 'ellipse', 'text', 'line'][(o_orderkey % 4 + 1)::INT] AS kind, o_orderkey % 640 AS x, o_orderkey % 360 AS y,
  o_orderkey % 97 + 1 AS width, o_orderkey % 53 + 1 AS height, CASE WHEN o_orderkey % 5 <> 0 THEN upper(printf('%06x', o_orderkey % 16777216)) END AS fill, o_orderpriority || ' <' || o_orderstatus || '>' AS text FROM orders),
shapes AS (SELECT package, slide_order, id, kind, 1 AS z, x, y, width, height, fill, CASE WHEN kind <> 'line' THEN text ELSE '' END AS text FROM d
  UNION ALL SELECT DISTINCT package, slide_order, 'title' || slide_order, 'text', 0, 0, 0, 1600, 80, NULL, 'Deck of ' || package FROM d),
edits AS (
  SELECT package, id, 'set-object-geometry' AS op FROM d WHERE k % 7 = 1 AND k % 17 <> 4
  UNION ALL SELECT package, id, 'set-text' FROM d WHERE k % 11 = 2 AND kind <> 'line' AND k % 17 <> 4
  UNION ALL SELECT package, id, 'set-native-style' FROM d WHERE k % 13 = 3 AND fill IS NOT NULL AND k % 17 <> 4
  UNION ALL SELECT package, id, 'object-missing' FROM d WHERE k % 17 = 4
  UNION ALL SELECT package, 'new' || id, 'object-new' FROM d WHERE k % 19 = 5)"""


def _objects(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").selectExpr(
        "concat('c', o_custkey) AS package", "o_orderkey % 3 AS slide_order", "concat('o', o_orderkey) AS id", "element_at(array('rect', 'ellipse', 'text', 'line'), cast(o_orderkey % 4 + 1 AS int)) AS kind", "1 AS z", "o_orderkey % 640 AS x", "o_orderkey % 360 AS y",
        "o_orderkey % 97 + 1 AS width", "o_orderkey % 53 + 1 AS height", "CASE WHEN o_orderkey % 5 <> 0 THEN concat('#', lpad(hex(o_orderkey % 16777216), 6, '0')) END AS fill", "concat(o_orderpriority, ' <', o_orderstatus, '>') AS text", "o_orderkey AS k",
    )
    titles = d.select("package", "slide_order").distinct().selectExpr(
        "package", "slide_order", "concat('title', slide_order) AS id", "'text' AS kind", "0 AS z", "0 AS x", "0 AS y", "1600 AS width", "80 AS height", "cast(NULL AS string) AS fill", "concat('Deck of ', package) AS text", "-1 AS k"
    )
    return d.unionByName(titles)


def _edited(objects: DataFrame) -> DataFrame:
    """Moved, retitled, repainted, dropped and copied shapes."""
    kept = objects.where("k % 17 <> 4 OR k < 0")
    new = objects.where("k % 19 = 5").withColumn("id", F.concat(F.lit("new"), "id"))
    changed = kept.withColumns({
        "x": F.expr("CASE WHEN k % 7 = 1 THEN x + 5 ELSE x END"), "text": F.expr("CASE WHEN k % 11 = 2 THEN text || '!' ELSE text END"),
        "fill": F.expr("CASE WHEN k % 13 = 3 AND fill IS NOT NULL THEN '#0A0B0C' ELSE fill END"),
    })
    return changed.unionByName(new)


def _saved(parts: DataFrame) -> DataFrame:
    """What an application adds on saving: the preset of the slide size, and properties of its own."""
    size = F.replace(F.decode("content", "UTF-8"), F.lit('cy="6858000"/>'), F.lit('cy="6858000" type="screen16x9"/>'))
    out = parts.withColumn("content", F.when(F.col("name") == D.MAIN, F.encode(size, "UTF-8")).otherwise(F.col("content")))
    own = parts.where(F.col("name") == D.MAIN).select("package", F.lit("docProps/app.xml").alias("name"), F.encode(F.lit("<Properties/>"), "UTF-8").alias("content"))
    return out.unionByName(own)


def _sides(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, and the parts of both sides as they are read from archives."""
    objects = _objects(spark, sf)
    opened = lambda parts: P.read_parts(P.write_packages(parts)).select("package", "name", "content")
    return objects.drop("k"), opened(D.compile_decks(objects.drop("k"))), opened(_saved(D.compile_decks(_edited(objects).drop("k"))))


@query("k9_k14_r12_u13_compiled_decks", f"""WITH {DECKS_SQL}, s AS (SELECT *, dense_rank() OVER (PARTITION BY package ORDER BY slide_order) AS n, row_number() OVER (PARTITION BY package, slide_order ORDER BY z, id) - 1 AS k FROM shapes)
SELECT package, 'ppt/slides/slide' || n || '.xml' AS name, k::INT AS ordinal, (k + 2)::VARCHAR AS shape_id, id AS shape_name, kind = 'line' AS connector, x::DOUBLE AS x, y::DOUBLE AS y, width::DOUBLE AS width, height::DOUBLE AS height,
  CASE kind WHEN 'text' THEN 'rect' ELSE kind END AS preset, fill, text FROM s""")
def k9_decks(spark, sf):
    """Decks are compiled, archived, opened and inspected: what comes back is what went in."""
    archives = P.write_packages(D.compile_decks(_objects(spark, sf).drop("k")))
    return N.slide_objects(P.read_parts(archives)).drop("residue", "groups")


@query("k10_j17_package_graph", "WITH d AS (SELECT 'c' || o_custkey AS package, count(DISTINCT o_orderkey % 3) AS n FROM orders GROUP BY ALL) SELECT package, 9 + 2 * n AS n_parts, 6 + 2 * n AS n_relationships, n + 1 AS n_to_layout, 6 + n AS n_types FROM d")
def k10_graph(spark, sf):
    parts = D.compile_decks(_objects(spark, sf).drop("k"))
    rels = P.relationships(parts).groupBy("package").agg(F.count("*").alias("n_relationships"), F.count_if(F.col("target") == D.LAYOUT).alias("n_to_layout"))
    types = P.content_types(parts).groupBy("package").agg(F.count("*").alias("n_types"))
    return parts.groupBy("package").agg(F.count("*").alias("n_parts")).join(rels, "package").join(types, "package")


@query("r10_package_graph_findings", """WITH d AS (SELECT o_custkey AS c, 'c' || o_custkey AS package, count(DISTINCT o_orderkey % 3) AS n FROM orders GROUP BY ALL)
SELECT package, 'MISSING-TARGET' AS code, n + 1 AS n FROM d WHERE c % 4 = 0 UNION ALL SELECT package, 'NAME-COLLISION', 1 FROM d WHERE c % 4 = 1""")
def r10_findings(spark, sf):
    """Decks without their layout, and decks with a second part of one name."""
    parts = D.compile_decks(_objects(spark, sf).drop("k"))
    turn = F.substring("package", 2, 20).cast("long") % 4
    twice = parts.where((turn == 1) & (F.col("name") == D.THEME)).withColumn("name", F.upper("name"))
    parts = parts.where((turn != 0) | (F.col("name") != D.LAYOUT)).unionByName(twice).withColumn("problem", F.lit(None).cast("string"))
    return P.graph_findings(parts).groupBy("package", "code").agg(F.count("*").alias("n"))


@query("r2_r6_part_states", """WITH d AS (SELECT o_custkey AS c, 'c' || o_custkey AS package FROM orders GROUP BY ALL)
SELECT package, CASE c % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'new' END AS state FROM d""")
def r2_states(spark, sf):
    """One part of each deck is left out, changed or added; relationship ids and the order of entries say nothing."""
    parts = D.compile_decks(_objects(spark, sf).drop("k"))
    turn = F.substring("package", 2, 20).cast("long") % 3
    text = F.decode("content", "UTF-8")
    other = F.when((turn == 1) & (F.col("name") == D.THEME), F.replace(text, F.lit('name="Plain"'), F.lit('name="Other"'))).when(
        F.col("name").isin(D.MAIN, "ppt/_rels/presentation.xml.rels"), F.regexp_replace(text, '(r:id|Id)="rId', '$1="rId9')
    )
    theme, name, content = F.col("name") == D.THEME, F.col("name"), F.col("content")
    held = lambda sides, name, content: F.struct(F.array(*map(F.lit, sides)).alias("sides"), name.alias("name"), content.alias("content"))
    more = F.when((turn == 2) & theme, held("e", F.lit("ppt/theme/theme2.xml"), content))
    # Both sides of a part are made where it is, so a deck is compiled once and stays where it was put together.
    each = F.when((turn == 0) & theme, F.array(held("b", name, content))).when(other.isNull(), F.array(held("be", name, content), more)).otherwise(F.array(held("b", name, content), held("e", name, F.encode(other, "UTF-8")), more))
    signed = P.part_signatures(parts.select("package", F.explode(F.array_compact(each)).alias("s")).select("package", "s.*"), "sides")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("signature"))).alias(side)
    state = F.when(F.col("e").isNull(), "missing").when(F.col("b").isNull(), "new").otherwise("changed")
    return signed.groupBy("package", "name").agg(of("b"), of("e")).where("NOT b <=> e").select("package", state.alias("state"))


@query("r1_r3_u14_package_findings", f"WITH {DECKS_SQL} SELECT package, id AS subject, op, CASE op WHEN 'object-new' THEN 'refused' WHEN 'object-missing' THEN 'review' ELSE 'auto-fixable' END AS disposition FROM edits")
def r1_findings(spark, sf):
    _, base, edited = _sides(spark, sf)
    return D.reconcile_packages(base, edited)[1].select("package", "subject", "op", "disposition")


@query("r1_r9_u14_package_status", f"""WITH {DECKS_SQL} SELECT package, count(*) FILTER (op LIKE 'set%') AS n_auto_fixable, count(*) FILTER (op = 'object-missing') AS n_review, count(*) FILTER (op = 'object-new') AS n_refused,
  CASE WHEN bool_or(op = 'object-new') THEN 'refused' WHEN bool_or(op = 'object-missing') THEN 'review-required' WHEN bool_or(op LIKE 'set%') THEN 'patchable' ELSE 'unchanged' END AS status
FROM (SELECT DISTINCT package FROM d) LEFT JOIN edits USING (package) GROUP BY package""")
def r1_status(spark, sf):
    _, base, edited = _sides(spark, sf)
    return D.reconcile_packages(base, edited)[2].select("package", "n_auto_fixable", "n_review", "n_refused", "status")


RULES_SQL = ", ".join(f"({v}, '{rule}', '{predicate}', {str(passed).lower()})" for v, rule, predicate, passed in EXPECTED)


def _rule_parts(spark, sf: str) -> DataFrame:
    """A package an order: one of the cases that a rule fits or just misses."""
    rows = [(v, name, bytearray(text.encode())) for v, parts in CASES.items() for name, text in parts]
    cases = spark.createDataFrame(rows, "v int, name string, content binary")
    return table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("package"), (F.col("o_orderkey") % 29).cast("int").alias("v")).join(cases, "v").drop("v")


@query("n4_n11_normalisation_proofs", f"""SELECT 'o' || o_orderkey AS package, rule, predicate, passed FROM orders JOIN (VALUES {RULES_SQL}) e(v, rule, predicate, passed) ON o_orderkey % 29 = v""")
def n4_proofs(spark, sf):
    """Every predicate of every rule at the place it looks at, held or not."""
    proofs = lambda parts: N.proofs(N.candidates(SharedTables(spark, "proofs").cut("nodes", N.read_nodes(parts))))
    return P.once_per_content(_rule_parts(spark, sf), proofs).select("package", "rule", "predicate", "passed")


@query("n4_n11_a14_normalisation_evidence", f"""WITH e AS (SELECT v, rule, bool_and(passed) AS fires FROM (VALUES {RULES_SQL}) e(v, rule, predicate, passed) GROUP BY ALL)
SELECT 'o' || o_orderkey AS package, rule, 1 AS n FROM orders JOIN e ON o_orderkey % 29 = v WHERE fires""")
def n4_rules(spark, sf):
    """A rule fires only where all its predicates hold."""
    return P.once_per_content(_rule_parts(spark, sf), lambda parts: N.evidence_by_rule(N.normalise(parts)[1])).select("package", "rule", "n")


@query("s21_s23_xml_nodes", """WITH d AS (SELECT doc_id, 1 + doc_id % 4 AS depth, doc_id % 3 AS kids, coalesce(len(regexp_extract_all(text, '<|&')), 0) AS marks FROM documents),
n AS (SELECT doc_id, unnest(range(1, depth + 1)) AS level, kids, depth, marks FROM d)
SELECT doc_id::VARCHAR AS package, level::INT AS depth, '{urn:' || CASE WHEN level % 2 = 0 THEN 'b' ELSE 'a' END || '}n' AS tag, CASE WHEN level = depth THEN kids ELSE 1 END + CASE WHEN level = depth THEN 1 ELSE 0 END AS n_children, CASE WHEN level = depth THEN marks ELSE 0 END AS n_marks FROM n""")
def xml_nodes(spark, sf):
    """Documents wrapped in elements whose prefix changes its namespace from level to level; texts come back as they were."""
    depth = F.col("doc_id") % 4 + 1
    space = lambda k: F.when(k % 2 == 0, "urn:b").otherwise("urn:a")
    opens = F.array_join(F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(F.lit('<x:n xmlns:x="'), space(k), F.lit('">'))), "")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    kids = F.repeat(F.lit("<!-- <k> --><k a='>'/>"), (F.col("doc_id") % 3).cast("int"))
    xml = F.concat(opens, F.lit("<t>"), escape_xml(text), F.lit("</t>"), kids, F.repeat(F.lit("</x:n>"), depth.cast("int")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("package"), F.lit("part.xml").alias("name"), F.encode(xml, "UTF-8").alias("content"))
    nodes = SharedTables(spark, "xml").cut("nodes", T.read_elements(docs))
    below = nodes.groupBy("package", F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum(F.regexp_count("text", F.lit("[<&]"))).alias("n_marks"))
    out = nodes.where("tag LIKE '%}n'").join(below, ["package", "node"], "left")
    return out.select("package", "depth", "tag", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_marks", F.lit(0)).alias("n_marks"))
