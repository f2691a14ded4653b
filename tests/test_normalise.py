from docloom.operators import normalise as N
from docloom.plans.rule_cases import CASES, EXPECTED, SPACES

ROOT = f'<p:sld {SPACES}>%s</p:sld>'


def _parts(spark, rows, package="p"):
    return spark.createDataFrame([(package, n, bytearray(t.encode())) for n, t in rows], "package string, name string, content binary")


def test_every_case_fires_or_stays(spark):
    """Exact shapes go, and what comes near but fails one predicate stays as it is, in the bytes too."""
    rows = [(f"v{v}", n, bytearray(t.encode())) for v, parts in CASES.items() for n, t in parts]
    parts = spark.createDataFrame(rows, "package string, name string, content binary")
    after, evidence = N.normalise(parts)
    fired = {(r.package, r.rule) for r in evidence.collect()}
    held = {}
    for v, rule, _, passed in EXPECTED:
        held[f"v{v}", rule] = held.get((f"v{v}", rule), True) and passed
    assert fired == {k for k, ok in held.items() if ok}
    got = {(r.package, r.name): bytes(r.content).decode() for r in after.collect()}
    for v, parts in CASES.items():
        rules = {rule for p, rule in fired if p == f"v{v}"}
        for name, text in parts:
            if not rules:
                assert got[f"v{v}", name] == text
            elif rules & {"view-properties-inert", "table-styles-inert", "generated-metadata"}:
                left = got.get((f"v{v}", name))
                assert left is None or not any(part in left for part in (N.VIEW, N.TABLES, "docProps/app.xml"))
    assert got["v20", N.MAIN].count('type="screen16x9"') == 1
    assert '<p:grpSpPr></p:grpSpPr>' in got["v22", "ppt/slides/slide1.xml"]
    assert "objectDefaults" not in got["v24", N.THEME]
    assert got["v10", N.PROPERTIES].endswith("></p:presentationPr>")
    assert "endParaRPr" not in got["v14", "ppt/slides/slide1.xml"] and "endParaRPr" in got["v15", "ppt/slides/slide1.xml"]


def test_slide_objects_and_identities(spark):
    shape = '<p:sp><p:nvSpPr><p:cNvPr id="%d" name="%s"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr>%s</p:sp>'
    frame = '<p:spPr><a:xfrm><a:off x="7620" y="0"/><a:ext cx="15240" cy="7620"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:txBody>'
    tree = "<p:cSld><p:spTree>" + shape % (2, "a", frame) + shape % (3, "b", "") + shape % (4, "b", "") + "</p:spTree></p:cSld>"
    found = N.slide_objects(_parts(spark, [("ppt/slides/slide1.xml", ROOT % tree)]))
    a = found.where("shape_name = 'a'").first()
    assert (a.shape_id, a.x, a.y, a.width, a.height, a.preset, a.text) == ("2", 1.0, 0.0, 2.0, 1.0, "rect", "Hi")
    mapped = spark.createDataFrame([("p", n) for n in "abc"], "package string, shape_name string")
    assert {r.shape_name: r.status for r in N.object_identities(mapped, found).collect()} == {"a": "unique", "b": "duplicate", "c": "missing"}


def test_groups_move_and_scale_what_is_in_them(spark):
    """A group inside a group: children's coordinates pass through both, at any depth; a flat group has no world frame."""
    sp = '<p:sp><p:nvSpPr><p:cNvPr id="9" name="%s"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm%s><a:off x="76200" y="152400"/><a:ext cx="76200" cy="76200"/></a:xfrm></p:spPr></p:sp>'
    grp = '<p:grpSp><p:nvGrpSpPr><p:cNvPr id="5" name="%s"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="%d" y="0"/><a:ext cx="%d" cy="762000"/><a:chOff x="0" y="0"/><a:chExt cx="%d" cy="762000"/></a:xfrm></p:grpSpPr>%s</p:grpSp>'
    inner = grp % ("in", 76200, 381000, 762000, sp % ("deep", ""))
    tree = "<p:cSld><p:spTree>" + grp % ("out", 762000, 1524000, 762000, inner + sp % ("one", "")) + grp % ("flat", 0, 10, 0, sp % ("lost", "")) + sp % ("turned", ' rot="60000"') + "<p:pic/></p:spTree></p:cSld>"
    parts = _parts(spark, [("ppt/slides/slide1.xml", ROOT % tree)])
    got = {r.shape_name: r for r in N.slide_objects(parts).collect()}
    assert [got["one"][c] for c in ("x", "y", "width", "height")] == [100 + 2 * 10, 20, 2 * 10, 10]
    assert [got["deep"][c] for c in ("x", "y", "width", "height")] == [100 + 2 * (10 + 0.5 * 10), 20, 10, 10]
    assert got["deep"].groups == ["out", "in"] and got["one"].groups == ["out"]
    assert got["lost"].x is None
    refused = {(r.code, r.subject) for r in N.slide_refusals(parts).collect()}
    assert refused == {("PICTURE", "pic"), ("GROUP-WITHOUT-EXTENT", "lost"), ("TURNED", "turned")}
