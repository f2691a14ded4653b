"""Small packages that a normalising rule fits exactly or just misses, and what each of its predicates says there."""

from __future__ import annotations

from docloom.operators import normalise as N

SPACES = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:p14="http://schemas.microsoft.com/office/powerpoint/2010/main" xmlns:p15="http://schemas.microsoft.com/office/powerpoint/2012/main"'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{}</Types>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'

_RATIO = '<p:scale><a:sx n="1" d="2"/><a:sy n="1" d="2"/></p:scale><p:origin x="-3" y="0"/>'
_VIEW = (
    f'<p:viewPr {SPACES}><p:normalViewPr><p:restoredLeft sz="15620"/><p:restoredTop sz="94660"/></p:normalViewPr><p:slideViewPr><p:cSldViewPr snapToGrid="0"><p:cViewPr varScale="1">{_RATIO}</p:cViewPr><p:guideLst/></p:cSldViewPr></p:slideViewPr>'
    f'<p:notesTextViewPr><p:cViewPr>{_RATIO}</p:cViewPr></p:notesTextViewPr><p:gridSpacing cx="76200" cy="76200"/></p:viewPr>'
)
_TABLES = f'<a:tblStyleLst {SPACES} def="{N.TABLE_STYLE}"/>'
_EXTENSIONS = "".join(f'<p:ext uri="{uri}"><{"p15" if "chart" in tag else "p14"}:{tag.rpartition("}")[2]} val="{value}"/></p:ext>' for uri, tag, value in N.EXTENSIONS)
_PROPERTIES = f"<p:presentationPr {SPACES}><p:extLst>{_EXTENSIONS}</p:extLst></p:presentationPr>"
_ZERO = '<p:grpSpPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/><a:chOff x="0" y="0"/><a:chExt cx="0" cy="0"/></a:xfrm></p:grpSpPr>'


def _optional(part: str, text: str, links: int = 1, right: bool = True) -> list[tuple[str, str]]:
    kind, content_type = N.OPTIONAL[part]
    link = f'<Relationship Id="rId{{}}" Type="{kind}" Target="{part[4:]}"/>'
    return [
        (N.TYPES, TYPES.format(f'<Override PartName="/{part}" ContentType="{content_type if right else "application/xml"}"/>')),
        ("ppt/_rels/presentation.xml.rels", RELS.format("".join(link.format(k) for k in range(links)))),
        (part, text),
    ]


def _slide(paragraph: str) -> list[tuple[str, str]]:
    return [("ppt/slides/slide1.xml", f"<p:sld {SPACES}><p:txBody>{paragraph}</p:txBody></p:sld>")]


def _tree(group: str) -> list[tuple[str, str]]:
    return [("ppt/slides/slide1.xml", f"<p:sld {SPACES}><p:cSld><p:spTree>{group}</p:spTree></p:cSld></p:sld>")]


def _size(text: str) -> list[tuple[str, str]]:
    return [(N.MAIN, f"<p:presentation {SPACES}>{text}</p:presentation>")]


_RUN = '<a:p><a:r><a:rPr lang="en" sz="1800"><a:latin typeface="Arial"/></a:rPr><a:t>x</a:t></a:r>{}</a:p>'
_PICTURE = ("ppt/slides/slide9.xml", f"<p:sld {SPACES}><p:pic/></p:sld>")

CASES: dict[int, list[tuple[str, str]]] = {
    0: _optional(N.VIEW, _VIEW),
    1: _optional(N.VIEW, _VIEW.replace('sz="15620"', 'sz="100001"')),
    2: _optional(N.VIEW, _VIEW.replace("<p:guideLst/>", '<p:guideLst><p:guide pos="1"/></p:guideLst>')),
    3: _optional(N.VIEW, _VIEW, links=2),
    4: _optional(N.VIEW, _VIEW, right=False),
    5: _optional(N.TABLES, _TABLES),
    6: [*_optional(N.TABLES, _TABLES), _PICTURE],
    7: _optional(N.TABLES, _TABLES.replace("/>", "><a:tblStyle/></a:tblStyleLst>")),
    10: [(N.PROPERTIES, _PROPERTIES)],
    11: [(N.PROPERTIES, f'<p:presentationPr {SPACES}><p:showPr loop="1"><p:kiosk/></p:showPr></p:presentationPr>')],
    12: [(N.PROPERTIES, _PROPERTIES.replace('val="220"', 'val="96"'))],
    13: [(N.PROPERTIES, _PROPERTIES), _PICTURE],
    14: _slide(_RUN.format('<a:endParaRPr sz="1800" lang="en"><a:latin typeface="Arial"/></a:endParaRPr>')),
    15: _slide(_RUN.format('<a:endParaRPr sz="4000" b="1"/>')),
    16: _slide('<a:p><a:endParaRPr lang="en"/></a:p>'),
    17: _slide("<a:p><a:r><a:t>x</a:t></a:r><a:endParaRPr/></a:p>"),
    20: _size('<p:sldSz cx="12192000" cy="6858000"/>'),
    21: _size('<p:sldSz cx="12192000" cy="6858001"/>'),
    22: _tree(_ZERO),
    23: _tree(_ZERO.replace("<a:xfrm>", '<a:xfrm rot="1">')),
    24: [(N.THEME, f"<a:theme {SPACES}><a:objectDefaults/></a:theme>")],
    25: [(N.THEME, f"<a:theme {SPACES}><a:objectDefaults><a:spDef/></a:objectDefaults></a:theme>")],
    26: [("docProps/app.xml", "<Properties/>"), ("_rels/.rels", RELS.format('<Relationship Id="rId9" Type="t" Target="docProps/app.xml"/>'))],
}


def _expected() -> list[tuple[int, str, str, bool]]:
    out = []

    def say(v: int, rule: str, failing: set[str], *predicates: str) -> None:
        out.extend((v, rule, p, p not in failing) for p in predicates)

    for v, failing in ((0, set()), (1, {"exact-shape"}), (2, {"exact-shape"}), (3, {"internal-relationship"}), (4, {"content-type"})):
        say(v, "view-properties-inert", failing, "content-type", "internal-relationship", "exact-shape")
    for v, failing in ((5, set()), (6, {"no-affected-content"}), (7, {"exact-shape"})):
        say(v, "table-styles-inert", failing, "content-type", "internal-relationship", "no-affected-content", "exact-shape")
    for v, failing in ((10, set()), (11, {"exact-known-defaults"}), (12, {"exact-known-defaults"}), (13, {"no-affected-content"})):
        say(v, "presentation-property-defaults", failing, "no-affected-content", "exact-known-defaults")
    for v, failing in ((14, set()), (15, {"run-and-end-styles-equal"}), (16, {"has-runs"}), (17, set())):
        say(v, "end-paragraph-style-marker-omitted", failing, "one-marker", "has-runs", "run-and-end-styles-equal")
    for v, failing in ((20, set()), (21, {"slide-height-emu"})):
        say(v, "slide-size-preset-omitted", failing, "one-size", "slide-width-emu", "slide-height-emu", "preset-absent")
    for v, failing in ((22, set()), (23, {"all-root-transform-values-zero"})):
        say(v, "root-zero-group-transform", failing, "one-root-group", "all-root-transform-values-zero")
    say(24, "theme-empty-defaults", set(), "empty-attribute-free-container")
    say(25, "theme-empty-defaults", {"empty-attribute-free-container"}, "empty-attribute-free-container")
    say(26, "generated-metadata", set(), "generated-part")
    return out


EXPECTED = _expected()
