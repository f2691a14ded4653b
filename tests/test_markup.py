from pyspark.sql import functions as F

from docloom.functions.json_text import canonical_json, json_facts
from docloom.operators import model as M
from docloom.operators import ranges as R
from docloom.operators import objects as O
from docloom.sources import markup as K

DECK = """<!doctype html><html data-demo-version="1"><head><meta charset="utf-8"></head><body>
<script id="m" type="application/x+json">{"title": "T", "theme": "light", "slides": ["cover", {"id": "plan", "hidden": true}]}</script>
<template data-demo-slide="plan"><svg id="plan">
 <rect id="plan.bg" class="bg" data-demo-role="shape" x="0" y="0" width="16" height="9"/>
 <g id="plan.g" data-demo-role="group" transform="translate(100,40)">
  <circle id="plan.c" data-demo-role="shape" cx="20" cy="30" r="10"/>
  <g id="plan.i" data-demo-role="group" transform="translate(-5 10)"><rect id="plan.r" data-demo-role="shape" x="0" y="0" width="10" height="20"/></g>
  <rect id="plan.gone" data-demo-role="shape" data-demo-export="ignore" x="900" y="900" width="1" height="1"/>
  <ellipse id="plan.e" data-demo-role="shape" cx="50" cy="30" rx="5" ry="15"/>
 </g>
 <line id="plan.l" data-demo-role="connector" data-demo-from="plan.c" data-demo-to="plan.e" x1="5" y1="1" x2="1" y2="1"/>
</svg></template>
<template data-demo-slide="cover"><svg id="cover">
 <text id="cover.t" class="title" data-demo-role="text" data-demo-frame="1 2 3 4" fill="#abcdef" style="opacity: 0.5">Hello <tspan>World</tspan></text>
</svg></template>
<script type="text/css" data-demo-style="base">.bg { fill: var(--demo-back); } /* x { } */ .title { fill: #112233; font-size: 96px; }</script>
<script type="text/css" data-demo-theme="light">:root { --demo-back: #ffffff; }</script>
</body></html>"""


def _docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_objects_sections_and_manifest(spark):
    docs = _docs(spark, d=DECK)
    nodes, found = K.objects(docs), K.sections(docs)
    rows = {r.id: r for r in nodes.collect()}
    assert rows["plan.r"].ancestor_ids == ["plan.g", "plan.i"] and rows["plan.r"].depth == 2 and rows["plan.r"].family == "demo"
    assert rows["cover.t"].scope_id == "cover" and rows["cover.t"].text == "Hello\nWorld"
    assert [(r.slide_order, r.scope_id, r.hidden, r.theme) for r in K.manifests(found).orderBy("slide_order").collect()] == [(0, "cover", False, "light"), (1, "plan", True, "light")]
    assert O.query_objects(nodes, descendant_of="plan.g").count() == 5
    rules = {(r["class"], r.property): (r.literal, r.token) for r in K.style_rules(found).collect()}
    assert rules == {("bg", "fill"): (None, "back"), ("title", "fill"): ("#112233", None), ("title", "font-size"): ("96", None)}


def test_resolution(spark):
    docs = _docs(spark, d=DECK)
    nodes, found = K.objects(docs).cache(), K.sections(docs)
    bounds, styles = M.resolve(nodes, K.style_rules(found), K.theme_tokens(found), "light")
    b = {r.id: (r.x, r.y, r.width, r.height) for r in bounds.collect()}
    assert b["plan.c"] == (110.0, 60.0, 20.0, 20.0) and b["plan.e"] == (145.0, 55.0, 10.0, 30.0)
    assert b["plan.i"] == b["plan.r"] == (95.0, 50.0, 10.0, 20.0)
    assert b["plan.g"] == (95.0, 50.0, 60.0, 35.0) and "plan.gone" not in b
    s = {(r.id, r.property): (r.value, r.origin) for r in styles.collect()}
    assert s["plan.bg", "fill"] == ("#ffffff", "base-rule")
    assert s["cover.t", "fill"] == ("#112233", "base-rule") and s["cover.t", "opacity"] == ("0.5", "inline-style")
    order = {r.id: r.sibling_order for r in M.rendered(nodes).collect()}
    assert (order["plan.c"], order["plan.i"], order["plan.e"]) == (0, 1, 2)
    page = M.hydrate(nodes, styles, "cover").first().markup
    assert "class=" not in page and "fill:#112233" in page


def test_validation_and_gate(spark):
    bad = DECK.replace('data-demo-to="plan.e"', 'data-demo-to="nowhere"').replace('id="plan.bg"', 'id="plan.c"').replace('"theme": "light"', '"theme": "dusk"').replace('<text id="cover.t"', '<rect id="cover.t"')
    docs = _docs(spark, good=DECK, bad=bad)
    nodes, found = K.objects(docs), K.sections(docs)
    diagnostics = M.validate(nodes, K.manifests(found), found).cache()
    assert {r.code for r in diagnostics.where("doc_id = 'bad'").collect()} == {"ENDPOINT-MISSING", "ID-DUPLICATE", "THEME-REFERENCE", "ROLE-ELEMENT"}
    assert diagnostics.where("doc_id = 'good'").count() == 0
    assert {r.doc_id for r in M.gated(nodes, diagnostics).collect()} == {"good"}


def test_tag_soup_and_empty_documents(spark):
    docs = _docs(spark, a="<p><b data-x-role='text' id='q'>hi<p>more", b="", c=None)
    assert [r.id for r in K.objects(docs).collect()] == ["q"] and K.sections(docs).count() == 0


def test_migration_changes_the_family_alone(spark):
    docs = _docs(spark, d=DECK)
    new = R.migrate(docs, "demo", "next")
    assert new.first().proven and new.first().n_edits > 5
    a, b = K.objects(docs).drop("family"), K.objects(new).drop("family")
    assert {r.family for r in K.objects(new).collect()} == {"next"}
    as_text = lambda df: df.select("id", F.to_json(F.struct("scope_id", "parent_id", "role", "element", "text", F.map_entries("attributes").alias("a"))).alias("t"))
    assert as_text(a).exceptAll(as_text(b)).count() == 0


def test_json_text(spark):
    rows = spark.createDataFrame([('{"b": 1.0, "a": [2, {"d": null, "c": "é"}]}',), ('{"k": 1, "k": 2}',), ("nope",), (None,)], "t string")
    got = rows.select(canonical_json("t").alias("c"), json_facts("t").alias("f")).collect()
    assert got[0].c == '{"a":[2,{"c":"é","d":null}],"b":1}' and got[0].f["depth"] == 3
    assert got[1].f["repeated"] == ["k"] and got[2].c is None and got[3].f["depth"] is None


def test_faces(spark):
    lines = spark.createDataFrame([("a", '"Inter"', 400, "normal"), ("b", "Other", 400, "normal")], "id string, family string, weight int, style string")
    faces = spark.createDataFrame([("inter", 400, "normal", "f1")], "family string, weight int, style string, face string")
    assert {r.id: r.face for r in M.with_faces(lines, faces).collect()} == {"a": "f1", "b": None}


def test_two_documents_with_the_same_ids_resolve_apart(spark):
    other = DECK.replace("#112233", "#445566").replace('translate(100,40)', 'translate(0,0)').replace("--demo-back: #ffffff", "--demo-back: #000011")
    docs = _docs(spark, a=DECK, b=other)
    nodes, found = K.objects(docs).cache(), K.sections(docs)
    bounds, styles = M.resolve(nodes, K.style_rules(found), K.theme_tokens(found), "light")
    b = {(r.doc_id, r.id): (r.x, r.y, r.width, r.height) for r in bounds.collect()}
    assert b["a", "plan.c"] == (110.0, 60.0, 20.0, 20.0) and b["b", "plan.c"] == (10.0, 20.0, 20.0, 20.0)
    assert b["a", "plan.g"] == (95.0, 50.0, 60.0, 35.0) and b["b", "plan.g"][2:] == (60.0, 35.0)
    s = {(r.doc_id, r.id, r.property): r.value for r in styles.collect()}
    assert (s["a", "cover.t", "fill"], s["b", "cover.t", "fill"]) == ("#112233", "#445566")
    assert (s["a", "plan.bg", "fill"], s["b", "plan.bg", "fill"]) == ("#ffffff", "#000011")
    pages = {r.doc_id: r.markup for r in M.hydrate(nodes, styles, "cover").collect()}
    assert "fill:#112233" in pages["a"] and "fill:#445566" in pages["b"]


def test_hydration_escapes_what_parsing_decoded(spark):
    deck = DECK.replace("Hello <tspan>World</tspan>", "a &lt; b &amp; c").replace('fill="#abcdef"', 'fill="#abcdef" data-demo-note="say &quot;hi&quot; &lt;now&gt;"')
    docs = _docs(spark, d=deck)
    nodes, found = K.objects(docs).cache(), K.sections(docs)
    _, styles = M.resolve(nodes, K.style_rules(found), K.theme_tokens(found), "light")
    page = M.hydrate(nodes, styles, "cover").first().markup
    assert ">a &lt; b &amp; c</text>" in page and 'note="say &quot;hi&quot; &lt;now&gt;"' in page
    again = K.objects(_docs(spark, e=page.replace("note=", "data-demo-note=").replace("role=", "data-demo-role="))).first()
    assert again.text == "a < b & c" and again.attributes["note"] == 'say "hi" <now>'


def test_security_findings_whatever_the_quotes(spark):
    from docloom.sources import documents as D

    pages = {
        1: """<a onclick="x()" href="http://x">""", 2: "<a onclick='x()' href='http://x'>", 3: "<a onclick=x() href=http://x>", 4: """<a title="a > b" onclick='x()' href = http://x>""",
        5: """<a href="#a" class=on>""", 6: "<p style='color: url (x)'>", 7: """<p style="&#117;rl(x)">""", 8: "text < b and <SCRIPT src=x></script>", 9: "<a" + " b='c'" * 20_000 + " onload=x>",
    }
    docs = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = {(r.page_id, r.code) for r in D.security_findings(docs).collect()}
    both = {(k, c) for k in (1, 2, 3, 4) for c in ("EVENT-HANDLER", "UNSAFE-URL")}
    assert got == both | {(6, "UNSAFE-CSS"), (7, "UNSAFE-CSS"), (8, "FORBIDDEN-ELEMENT"), (8, "UNSAFE-URL"), (9, "EVENT-HANDLER")}


def test_strict_xml(spark):
    svg = '<svg xmlns="http://www.w3.org/2000/svg">%s</svg>'
    docs = _docs(spark, good=svg % "<g a='1'/>", open=svg % "<g>", two=svg % "" + "<g/>", twice=svg % "<g a='1' a='2'/>", kind="<!DOCTYPE svg [<!ENTITY e 'x'>]>" + svg % "&e;", old='<?xml version="1.1"?>' + svg % "", prefix=svg % "<x:g/>", entity=svg % "&nbsp;", empty="", none=None, mark="﻿" + svg % "é")
    bad = dict.fromkeys(("open", "two", "twice", "entity", "empty", "none"), "XML-MALFORMED")
    assert {r.doc_id: r.code for r in K.xml_findings(docs).collect()} == bad | {"kind": "XML-DOCTYPE", "old": "XML-VERSION", "prefix": "XML-NAMESPACE"}
