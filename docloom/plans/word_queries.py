"""Word-processor packages and resolved targets over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import normalise as N
from docloom.operators import word as W
from docloom.plans.registry import query, table
from docloom.sources import packages as P


@query("k6_k7_s20_s22_embedded_sources", "SELECT doc_id::VARCHAR AS package, CASE WHEN doc_id % 5 <> 2 THEN coalesce(text, '') END AS original, CASE doc_id % 5 WHEN 1 THEN 'SOURCE-CHANGED' WHEN 2 THEN 'SOURCE-MISSING' END AS problem FROM documents WHERE doc_id % 5 <> 1 UNION ALL SELECT doc_id::VARCHAR, coalesce(text, '') || '!', 'SOURCE-CHANGED' FROM documents WHERE doc_id % 5 = 1")
def embedded(spark, sf):
    """Documents written as packages, archived and read again; of some the embedded source is changed or taken out."""
    parts = P.read_parts(P.write_packages(W.to_parts(table(spark, sf, "documents"))))
    turn = F.col("package").cast("long") % 5
    xml = F.decode("content", "UTF-8")
    body = F.regexp_extract(xml, '<original sha256="[0-9a-f]*">([^<]*)<', 1)
    longer = F.regexp_replace(F.base64(F.concat(F.unbase64(body), F.encode(F.lit("!"), "UTF-8"))), r"\s", "")
    spoilt = F.encode(F.concat(F.regexp_extract(xml, '(?s)^(.*<original sha256="[0-9a-f]*">)', 1), longer, F.regexp_extract(xml, "(?s)(</original>.*)$", 1)), "UTF-8")
    item = F.col("name") == W.SOURCE
    parts = parts.where(~item | (turn != 2)).withColumn("content", F.when(item & (turn == 1), spoilt).otherwise(F.col("content")))
    return W.embedded_source(parts).select("package", "original", "problem")


@query("f16_word_refusals", "SELECT doc_id::VARCHAR AS package, 'word/document.xml' AS name, ['REVISION', 'NUMBERING', 'DRAWING', 'FIELD', 'NOTE'][(doc_id % 7)::INT] AS code FROM documents WHERE doc_id % 7 BETWEEN 1 AND 5")
def refusals(spark, sf):
    """Bodies with a construct that Markdown would lose."""
    lost = ["<w:ins w:id='1'/>", "<w:numPr/>", "<w:drawing/>", "<w:fldSimple/>", "<w:footnoteReference/>"]
    kind = F.col("package").cast("long") % 7
    found = F.lit("")
    for k, construct in enumerate(lost, 1):
        found = F.when(kind == k, construct).otherwise(found)
    parts = W.to_parts(table(spark, sf, "documents").select("doc_id", F.lit("One plain paragraph.").alias("text")))
    body = F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("</w:body>"), F.concat(found, F.lit("</w:body>"))), "UTF-8")
    return W.refusals(parts.withColumn("content", F.when(F.col("name") == W.BODY, body).otherwise(F.col("content"))))


@query("c28_n2_resolved_targets", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS v FROM orders)
SELECT k, ['ppt/media/i' || k || '.png', 'ppt/slides/s.xml', 'docs/a.xml', 'x.xml', 'ppt/slides/b/c.xml', 'http://h/' || k][v + 1] AS target, v = 5 AS external FROM o""")
def targets(spark, sf):
    """Relative, rooted, dotted and external targets of one relationship part an order, read from its node rows."""
    given = F.lit(["../media/i{k}.png", "s.xml", "/docs/a.xml", "../../../x.xml", "./a/.././b//c.xml", "http://h/{k}"])
    target = F.replace(F.element_at(given, (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    mode = F.when(F.col("o_orderkey") % 6 == 5, ' TargetMode="External"').otherwise("")
    xml = F.concat(F.lit('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="t" Target="'), target, F.lit('"'), mode, F.lit("/></Relationships>"))
    parts = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("package"), F.lit("ppt/slides/_rels/slide1.xml.rels").alias("name"), F.encode(xml, "UTF-8").alias("content"))
    found = N.relations(N.T.read_elements(parts))
    return found.select(F.col("package").cast("long").alias("k"), "target", "external")
