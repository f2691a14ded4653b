"""Slides read where they are, against their node rows by windows and joins."""

from pyspark.sql import functions as F

from docloom import plans
from docloom.operators import normalise as N
from docloom.plans.rule_cases import SPACES
from docloom.sources.slides import read_slides
from tests.oracle import SF

SP = '<p:sp><p:nvSpPr><p:cNvPr id="9" name="%s" descr="a&#9;&quot;\\&#1;b"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm%s><a:off x="76200" y=" 152400 "/><a:ext cx="76200" cy="x"/></a:xfrm></p:spPr>%s</p:sp>'
GRP = '<p:grpSp><p:nvGrpSpPr><p:cNvPr id="5" name="%s"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="%d" y="0"/><a:ext cx="%d" cy="762000"/><a:chOff x="0" y="0"/><a:chExt cx="%d" cy="762000"/></a:xfrm></p:grpSpPr>%s</p:grpSp>'
BODY = '<p:txBody><a:off x="1" y="2"/><a:p/><a:p><a:r><a:rPr b="1"/><a:t>one </a:t></a:r><a:r><a:t><![CDATA[<two>]]></a:t></a:r></a:p><a:p><a:pPr/></a:p><a:p><a:r><a:t>three</a:t></a:r></a:p><a:p/></p:txBody>'
PAINT = '<a:prstGeom prst="rect"/><a:solidFill><a:srgbClr val="00FF00" x="1"/></a:solidFill><a:srgbClr val="FF0000"/> loose '
SLIDES = [
    SP % ("a", "", BODY + PAINT) + "<p:pic/>" + SP % ("b &amp; c", ' rot="60000"', PAINT) + SP % ("b &amp; c", "", ""),
    GRP % ("out", 762000, 1524000, 762000, GRP % ("in", 76200, 381000, 762000, SP % ("deep", "", BODY)) + SP % ("one", "", "")) + GRP % ("flat", 0, 10, 0, SP % ("lost", "", "")) + "<p:grpSp>" + SP % ("bare", "", "") + "</p:grpSp>",
    SP % ("outer", "", SP % ("nested", "", BODY) + PAINT) + '<q:sp xmlns:q="urn:q"/><p:cxnSp xmlns:a="urn:b"><a:t>not text</a:t></p:cxnSp>',
    SP % ("open", "", "<a:p><a:t>never closed"),
    "",
]


def test_slides_say_what_their_node_rows_say(spark):
    texts = [f"<p:sld {SPACES}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>" for s in SLIDES] + ["", "no markup", "﻿<p:sp xmlns:p='urn:other'/>"]
    parts = spark.createDataFrame([(f"p{k}", "ppt/slides/slide1.xml", bytearray(t.encode())) for k, t in enumerate(texts)], "package string, name string, content binary")
    plain = lambda df: sorted((repr(r.asDict(True)) for r in df.collect()))
    want, got = N.slide_shapes(N.slide_nodes(parts)), N.shapes_read(read_slides(parts))
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert got.count() == 11 and plain(got) == plain(want)
    nodes = N.read_nodes(parts)
    assert {r.package for r in read_slides(parts).where("rich").collect()} == {r.package for r in nodes.where(F.col("tag").isin(*N.RICH)).collect()} == {"p0"}
    assert {r.package for r in read_slides(parts).where("shell IS NOT NULL").collect()} == {r.package for r in nodes.where("leaf IS NULL").collect()}


def test_compiled_decks_are_inspected_without_node_tables(spark):
    """After the archives nothing is shuffled or sorted."""
    plan = plans.QUERIES["k9_k14_r12_u13_compiled_decks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_unpack") == 1 and "Window" not in plan and "Aggregate" not in plan.split("_unpack")[0]
