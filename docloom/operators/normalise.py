"""What an application changes in a package on saving without changing what a deck says, taken back with proof.

Parts are shredded into node rows (``sources.xml_tree``). A rule is a set of named predicates over them; it fires at a
place only if all hold there, and each predicate is a row of evidence, held or not. What comes near but fails one stays.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import splice
from docloom.operators.objects import ancestor_closure
from docloom.sources import xml_tree as T
from docloom.sources.packages import resolve_target
from docloom.sources.shared_tables import SharedTables
from docloom.sources.slides import LEAVES, RICH, A, C, P, read_slides

# Namespaces, parts, content types, relationship types and default values of the package format.
P14 = "{http://schemas.microsoft.com/office/powerpoint/2010/main}"
P15 = "{http://schemas.microsoft.com/office/powerpoint/2012/main}"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
OVERRIDE = "{http://schemas.openxmlformats.org/package/2006/content-types}Override"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN, VIEW, TABLES, PROPERTIES, TYPES = "ppt/presentation.xml", "ppt/viewProps.xml", "ppt/tableStyles.xml", "ppt/presProps.xml", "[Content_Types].xml"
GENERATED = ("docProps/app.xml", "docProps/core.xml")
PRESENTATIONML = "application/vnd.openxmlformats-officedocument.presentationml"
OPTIONAL = {VIEW: (f"{OFFICE}/viewProps", f"{PRESENTATIONML}.viewProps+xml"), TABLES: (f"{OFFICE}/tableStyles", f"{PRESENTATIONML}.tableStyles+xml")}
TABLE_STYLE = "{5C22544A-7EE6-4342-B048-85BDC9FD1C3A}"
WIDE = ("12192000", "6858000", "screen16x9")
ROOT_GROUP_PARTS = ("ppt/slides/slide1.xml", "ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml")
THEME = "ppt/theme/theme1.xml"
SLIDE = r"^ppt/slides/slide[0-9]+[.]xml$"
COUNT, WHOLE, FLAG = "[1-9][0-9]{0,14}", "-?[0-9]{1,15}", "[01]"


def _line(depth: int, tag: str, **attributes: str) -> str:
    """The line of ``xml_tree.shape_of`` for an element, as a pattern; attributes are patterns, optional ones end in ``?``."""
    own = ""
    for k, (name, value) in enumerate(sorted(attributes.items())):
        optional = value.endswith("]?")
        one = re.escape(f'{name}={{"v":"') + value.removesuffix("?" if optional else "") + re.escape('"}')
        own += f"(?:{one})?" if optional else (" " if k else "") + one
    return rf"{depth} {re.escape(tag)} {own} "


def _pattern(*lines: str) -> str:
    return "^" + "\n".join(lines) + "$"


def _common(depth: int, scaled: bool) -> list[str]:
    """A view's scale and origin."""
    ratio = {"d": COUNT, "n": COUNT}
    return [
        _line(depth, f"{P}cViewPr", **({"varScale": FLAG + "?"} if scaled else {})), _line(depth + 1, f"{P}scale"), _line(depth + 2, f"{A}sx", **ratio), _line(depth + 2, f"{A}sy", **ratio),
        _line(depth + 1, f"{P}origin", x=WHOLE, y=WHOLE),
    ]


# What the optional parts look like when they say nothing.
SIZE = "(?:[0-9]{1,5}|100000)"
VIEW_SHAPE = _pattern(
    _line(1, f"{P}viewPr"), _line(2, f"{P}normalViewPr"), _line(3, f"{P}restoredLeft", sz=SIZE), _line(3, f"{P}restoredTop", sz=SIZE), _line(2, f"{P}slideViewPr"),
    _line(3, f"{P}cSldViewPr", snapToGrid=FLAG + "?"), *_common(4, True), _line(4, f"{P}guideLst"), _line(2, f"{P}notesTextViewPr"), *_common(3, False), _line(2, f"{P}gridSpacing", cx=COUNT, cy=COUNT),
)
TABLE_SHAPE = _pattern(_line(1, f"{A}tblStyleLst", **{"def": re.escape(TABLE_STYLE)}))
EXTENSIONS = (
    ("{E76CE94A-603C-4142-B9EB-6D1370010A27}", f"{P14}discardImageEditData", "0"),
    ("{D31A062A-798A-4329-ABDD-BBA856620510}", f"{P14}defaultImageDpi", "220"),
    ("{FD5EFAAD-0ECE-453E-9831-46B23BE46B34}", f"{P15}chartTrackingRefBased", "0"),
)
PROPERTY_SHAPE = _pattern(_line(1, f"{P}presentationPr"), _line(2, f"{P}extLst"), *[x for uri, tag, value in EXTENSIONS for x in (_line(3, f"{P}ext", uri=re.escape(uri)), _line(4, tag, val=value))])
ZERO_SHAPE = _pattern(_line(5, f"{A}xfrm"), *[_line(6, f"{A}{t}", **{k: "0" for k in ks}) for t, ks in (("off", ("x", "y")), ("ext", ("cx", "cy")), ("chOff", ("x", "y")), ("chExt", ("cx", "cy")))])

_CHECKED = "package", "name", "rule", "place", "checks", "edit"


def _checked(rows: DataFrame, rule: str, checks: dict[str, Column], start=None, end=None, text=None) -> DataFrame:
    """Candidates of a rule as (package, name, rule, place, checks, edit); ``checks`` maps each predicate to whether it
    holds, and a null edit drops the part."""
    held = F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))])
    kind = "struct<start:int,end:int,replacement:string>"
    edit = F.lit(None).cast(kind) if start is None else F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), (F.lit(text) if isinstance(text, str) else text).alias("replacement"))
    return rows.select("package", "name", F.lit(rule).alias("rule"), F.col("node").alias("place"), held.alias("checks"), edit.alias("edit"))


def _only(c: str, **tests: str) -> Column:
    """An element of a collected list by conditions on its fields, and how many there are."""
    return F.filter(c, lambda e: reduce(lambda a, kv: a & (e[kv[0]] == kv[1]), tests.items(), F.lit(True)))


def read_nodes(parts: DataFrame) -> DataFrame:
    """The node rows of parts, with the leaf object and the paragraph that hold each."""
    return T.read_elements(parts, anchors={"leaf": tuple(f"{P}{t}" for t in LEAVES), "paragraph": (f"{A}p",)})


def relations(nodes: DataFrame) -> DataFrame:
    """Relationships of the node rows, each with the element that says it."""
    rels = nodes.where((F.col("tag") == RELATION) & F.col("name").endswith(".rels"))
    source = F.regexp_replace("name", r"_rels/([^/]*)[.]rels$", "$1")
    a = F.col("attributes")
    external = F.coalesce(a["TargetMode"] == "External", F.lit(False))
    return rels.select("package", "name", "node", "start", "end", source.alias("source"), a["Id"].alias("rid"), a["Type"].alias("type"), external.alias("external"), F.when(external, a["Target"]).otherwise(resolve_target(source, a["Target"])).alias("target"))


def _gates(nodes: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(package, rich, links, types): whether a package has pictures, charts or tables, the internal links from its main part,
    and its content types by part. ``heavy`` names packages that have such in slides without node rows."""
    rich = F.col("tag").isin(*RICH) | F.col("name").rlike("^ppt/(media|charts)/")
    a = F.col("attributes")
    types = F.when((F.col("tag") == OVERRIDE) & (F.col("name") == TYPES), F.struct(F.regexp_replace(a["PartName"], "^/", "").alias("part"), a["ContentType"].alias("type")))
    links = F.when(
        (F.col("tag") == RELATION) & (F.col("name") == "ppt/_rels/presentation.xml.rels") & (F.coalesce(a["TargetMode"], F.lit("Internal")) == "Internal"),
        F.struct(a["Type"].alias("type"), resolve_target(F.lit(MAIN), a["Target"]).alias("part")),
    )
    found = nodes.groupBy("package").agg(F.bool_or(rich).alias("rich"), F.collect_list(types).alias("types"), F.collect_list(links).alias("links"))
    if heavy is None:
        return found
    return found.join(heavy.select("package", F.lit(True).alias("heavy")).distinct(), "package", "left").withColumn("rich", F.col("rich") | F.col("heavy").isNotNull()).drop("heavy")


def candidates(nodes: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """(package, name, rule, place, checks, edit) of every place that a rule looks at, from node rows; ``heavy`` as in ``_gates``."""
    small = nodes.where(F.col("name").isin(VIEW, TABLES, PROPERTIES))
    root = F.min(F.struct("node", "inner", "until")).alias("root")
    whole = small.groupBy("package", "name").agg(root).join(T.shape_of(small, "package", "name"), ["package", "name"]).join(_gates(nodes, heavy), "package").withColumn("node", F.col("root.node"))

    def optional(part: str) -> dict[str, Column]:
        link, kind = OPTIONAL[part]
        held = F.filter("types", lambda t: t["part"] == part)
        return {"content-type": (F.size(held) == 1) & (held[0]["type"] == kind), "internal-relationship": F.size(F.filter("links", lambda x: (x["type"] == link) & (x["part"] == part))) == 1}

    plain = {"no-affected-content": ~F.col("rich")}
    view = _checked(whole.where(F.col("name") == VIEW), "view-properties-inert", {**optional(VIEW), "exact-shape": F.col("shape").rlike(VIEW_SHAPE)})
    tables = _checked(whole.where(F.col("name") == TABLES), "table-styles-inert", {**optional(TABLES), **plain, "exact-shape": F.col("shape").rlike(TABLE_SHAPE)})
    properties = _checked(whole.where(F.col("name") == PROPERTIES), "presentation-property-defaults", {**plain, "exact-known-defaults": F.col("shape").rlike(PROPERTY_SHAPE)}, F.col("root.inner"), F.col("root.until"), "")
    generated = _checked(nodes.where(F.col("name").isin(*GENERATED) & (F.col("depth") == 1)), "generated-metadata", {"generated-part": F.lit(True)})

    sizes = nodes.where((F.col("name") == MAIN) & (F.col("depth") == 2) & (F.col("tag") == f"{P}sldSz")).groupBy("package", "name").agg(F.count("*").alias("n"), F.min(F.struct("node", "inner")).alias("e"), F.first("attributes").alias("a")).withColumn("node", F.col("e.node"))
    mark = F.col("e.inner") - 2
    size = _checked(sizes, "slide-size-preset-omitted", {"one-size": F.col("n") == 1, "slide-width-emu": F.col("a")["cx"] == WIDE[0], "slide-height-emu": F.col("a")["cy"] == WIDE[1], "preset-absent": F.col("a")["type"].isNull()}, mark, mark, f' type="{WIDE[2]}"')

    lists = nodes.where((F.col("name") == THEME) & (F.col("depth") == 2) & F.col("tag").isin(f"{A}objectDefaults", f"{A}extraClrSchemeLst"))
    empty = (F.size("attributes") == 0) & F.trim("text").eqNullSafe("")
    bare = nodes.where((F.col("name") == THEME) & (F.col("depth") == 3)).select("package", "name", F.col("parent").alias("node"), F.lit(True).alias("filled")).distinct()
    theme = _checked(lists.join(bare, ["package", "name", "node"], "left"), "theme-empty-defaults", {"empty-attribute-free-container": empty & F.col("filled").isNull()}, F.col("start"), F.col("end"), "")
    return reduce(DataFrame.unionByName, [view, tables, properties, generated, size, theme, *_slide_candidates(nodes)])


def _slide_candidates(nodes: DataFrame) -> list[DataFrame]:
    """The candidates that slides have, too; they look at one part alone."""
    trees = nodes.where(F.col("name").isin(*ROOT_GROUP_PARTS)).where("depth <= 6 OR depth = 7").groupBy("package", "name").agg(F.array_sort(F.collect_list(F.when(F.col("depth").isin(2, 3) & F.col("tag").isin(f"{P}cSld", f"{P}spTree") | (F.col("depth") >= 4), F.struct("node", "close", "depth", "tag", "parent_tag", "inner", "until", F.concat_ws(" ", "depth", "tag", T.said(), F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("line"))))).alias("all"))
    group = _only("all", depth=4, tag=f"{P}grpSpPr", parent_tag=f"{P}spTree")
    trees = trees.withColumn("g", group).where("size(g) > 0").withColumn("node", F.col("g")[0]["node"])
    inside = F.array_join(F.transform(F.filter("all", lambda e: (e["node"] > F.col("g")[0]["node"]) & (e["node"] < F.col("g")[0]["close"])), lambda e: e["line"]), "\n")
    zero = _checked(
        trees, "root-zero-group-transform",
        {"one-root-group": (F.size("g") == 1) & (F.size(_only("all", depth=2, tag=f"{P}cSld")) == 1) & (F.size(_only("all", depth=3, tag=f"{P}spTree", parent_tag=f"{P}cSld")) == 1), "all-root-transform-values-zero": inside.rlike(ZERO_SHAPE)},
        F.col("g")[0]["inner"], F.col("g")[0]["until"], "",
    )

    slides = T.held_by(nodes.where(F.col("name").rlike(SLIDE)), "paragraph").where("below > 0")
    paragraphs = slides.groupBy("package", "name", "anchor").agg(F.array_sort(F.collect_list(F.struct("node", "close", "tag", "below", "start", "end", T.said().alias("said")))).alias("all"))
    at = lambda level, *tags: F.filter("all", lambda e: e["tag"].isin(*[f"{A}{t}" for t in tags]) & (e["below"] == level))
    ends, runs, styles = at(1, "endParaRPr"), at(1, "r", "fld", "br"), at(2, "rPr")
    inner = lambda s: F.array_join(F.transform(F.filter("all", lambda e: (e["node"] > s["node"]) & (e["node"] <= s["close"])), lambda e: F.concat_ws(" ", (e["below"] - s["below"]).cast("string"), e["tag"], e["said"])), "\n")
    style = lambda s: F.concat_ws("\n", s["said"], inner(s))
    paragraphs = paragraphs.withColumn("ends", ends).where("size(ends) > 0").withColumns({"runs": runs, "styles": styles}).withColumn("node", F.col("ends")[0]["node"])
    own = style(F.col("ends")[0])
    same = F.when(F.size("styles") == F.size("runs"), F.forall("styles", lambda s: style(s) == own)).otherwise((F.size("styles") == 0) & own.rlike(r"^\s*$"))
    marker = _checked(paragraphs, "end-paragraph-style-marker-omitted", {"one-marker": F.size("ends") == 1, "has-runs": F.size("runs") > 0, "run-and-end-styles-equal": same}, F.col("ends")[0]["start"], F.col("ends")[0]["end"], "")
    return [zero, marker]


def normalise_slides(slides: DataFrame, tables: SharedTables) -> DataFrame:
    """Slides (package, name, content) as ``normalise`` leaves them. Only those that have the elements of a rule get node rows."""
    text = F.decode("content", "UTF-8")
    seen = F.contains(text, F.lit("endParaRPr")) | (F.col("name").isin(*ROOT_GROUP_PARTS) & F.contains(text, F.lit("chExt")))
    nodes = tables.cut("slide-nodes", read_nodes(slides.where(seen)))
    fired = reduce(DataFrame.unionByName, _slide_candidates(nodes)).where(F.forall(F.map_values("checks"), lambda v: v))
    edits = tables.cut("slide-edits", fired.groupBy("package", "name").agg(F.array_sort(F.collect_list("edit")).alias("edits")))
    after = F.when(F.col("edits").isNull(), F.col("content")).otherwise(F.encode(splice(F.regexp_replace(text, "^\\x{FEFF}", ""), "edits"), "UTF-8"))
    return slides.join(edits, ["package", "name"], "left").select("package", "name", after.alias("content"))


def proofs(checked: DataFrame) -> DataFrame:
    """(package, name, rule, place, predicate, passed): every predicate of every candidate, a row each."""
    return checked.select("package", "name", "rule", "place", F.explode("checks").alias("predicate", "passed"))


def normalise(parts: DataFrame, tables: SharedTables | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts after, evidence): parts (package, name, content) with all proven rules applied, and (package, rule, name, place)
    of each that fired.

    The node rows and the candidates are written, since many rules read them. A part that is dropped takes the relationships
    to it and its content type with it.
    """
    return normalise_nodes(parts, tables)[:2]


def normalise_nodes(parts: DataFrame, tables: SharedTables | None = None, heavy: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``normalise`` (``heavy`` as in ``_gates``), and the node rows of the parts after it, written: only parts that a rule rewrote are read again."""
    tables = tables or SharedTables(parts.sparkSession, "normalise")
    nodes = tables.cut("given-nodes", read_nodes(parts.where("content IS NOT NULL AND name RLIKE '[.](xml|rels)$'")))
    fired = tables.cut("fired", candidates(nodes, heavy).where(F.forall(F.map_values("checks"), lambda v: v)).drop("checks"))
    gone = fired.where("edit IS NULL").select("package", F.col("name").alias("part")).distinct()
    # What points to a dropped part goes with it.
    said = relations(nodes).where("NOT external").select("package", "name", "start", "end", F.col("target").alias("part"))
    override = nodes.where((F.col("tag") == OVERRIDE) & (F.col("name") == TYPES)).select("package", "name", "start", "end", F.regexp_replace(F.col("attributes")["PartName"], "^/", "").alias("part"))
    follow = said.unionByName(override).join(gone, ["package", "part"], "left_semi").select("package", "name", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("").alias("replacement")).alias("edit"))
    edits = fired.where("edit IS NOT NULL").select("package", "name", "edit").unionByName(follow).groupBy("package", "name").agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    kept = parts.select("package", "name", "content").join(gone.withColumnRenamed("part", "name"), ["package", "name"], "left_anti").join(edits, ["package", "name"], "left")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "")
    after = F.when(F.col("edits").isNull(), F.col("content")).otherwise(F.encode(splice(text, "edits"), "UTF-8"))
    done = tables.cut("parts", kept.select("package", "name", after.alias("content"), F.col("edits").isNotNull().alias("edited")))
    out = done.drop("edited")
    again = read_nodes(done.where("edited AND name RLIKE '[.](xml|rels)$'"))
    # Few parts are rewritten or dropped; those that are not keep their rows.
    other = done.where("edited").select("package", "name").unionByName(gone.withColumnRenamed("part", "name"))
    stay = nodes.join(other, ["package", "name"], "left_anti")
    return out, fired.select("package", "rule", "name", "place"), tables.cut("nodes", stay.unionByName(again.select(*stay.columns)))


def evidence_by_rule(evidence: DataFrame) -> DataFrame:
    """(package, rule, n, names) of what fired."""
    return evidence.groupBy("package", "rule").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def embedded_marks(evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """Evidence with the objects of the same part whose markup holds its place, for findings that name objects."""
    return evidence.join(objects, ["package", "name"], "inner").where("place BETWEEN node AND close")


EMU = 7620


def _group_frames(nodes: DataFrame) -> DataFrame:
    """(package, name, node, group, scale and shift by axis): groups with the map from their children's coordinates to those
    they stand in; null where a group has no extent for its children."""
    inside = nodes.where((F.col("parent_tag") == f"{A}xfrm") & F.col("tag").isin(*[f"{A}{t}" for t in ("off", "ext", "chOff", "chExt")]))
    frames = nodes.where((F.col("tag") == f"{A}xfrm") & (F.col("parent_tag") == f"{P}grpSpPr")).select("package", "name", F.col("node").alias("xfrm"), F.col("parent").alias("properties"))
    owners = nodes.where(F.col("tag") == f"{P}grpSpPr").select("package", "name", F.col("node").alias("properties"), F.col("parent").alias("node"))
    a = lambda tag, k: F.max(F.when(F.col("tag") == f"{A}{tag}", F.col("attributes")[k].try_cast("double")))
    got = inside.join(frames, (inside["package"] == frames["package"]) & (inside["name"] == frames["name"]) & (inside["parent"] == frames["xfrm"])).select(inside["package"], inside["name"], "properties", "tag", "attributes")
    got = got.join(owners, ["package", "name", "properties"]).groupBy("package", "name", "node").agg(
        a("off", "x").alias("ox"), a("off", "y").alias("oy"), a("ext", "cx").alias("ex"), a("ext", "cy").alias("ey"), a("chOff", "x").alias("cx"), a("chOff", "y").alias("cy"), a("chExt", "cx").alias("wx"), a("chExt", "cy").alias("wy")
    )
    scale = lambda e, w: F.when(F.col(w) > 0, F.col(e) / F.col(w))
    return got.select("package", "name", "node", scale("ex", "wx").alias("sx"), scale("ey", "wy").alias("sy"), "ox", "oy", "cx", "cy")


def _leaf_rows(nodes: DataFrame) -> DataFrame:
    """One row a leaf object of a slide: its own elements in order, and the groups around it, outermost first."""
    slides = nodes.where(F.col("name").rlike(SLIDE))
    below = T.held_by(slides, "leaf")
    a = F.col("attributes")
    masked = F.when(F.col("tag") == f"{P}cNvPr", F.map_filter("attributes", lambda k, v: ~k.isin("id", "name"))).when((F.col("tag").isin(f"{A}off", f"{A}ext")) & (F.col("below") == 3), F.create_map().cast("map<string,string>")).when(F.col("tag") == f"{A}srgbClr", F.map_filter("attributes", lambda k, v: k != "val")).otherwise(a)
    plain = F.col("tag").isin(f"{A}p", f"{A}r", f"{A}t")
    line = F.concat_ws(" ", "below", "tag", T.said(masked), F.when(~plain, F.trim("text")))
    first = lambda tag, k, *where: F.min_by(F.when((F.col("tag") == tag) & reduce(Column.__and__, where, F.lit(True)), a[k]), F.when((F.col("tag") == tag) & reduce(Column.__and__, where, F.lit(True)), F.col("node")))
    frame = (F.col("below") == 3) & (F.col("parent_tag") == f"{A}xfrm")
    paragraph = F.sum(F.when(F.col("tag") == f"{A}p", 1).otherwise(0)).over(Window.partitionBy("package", "name", "anchor").orderBy("node"))
    own = below.withColumn("paragraph", paragraph).groupBy("package", "name", F.col("anchor").alias("node")).agg(
        F.max("close").alias("close"), F.first("anchor_tag").alias("tag"), F.min(F.when(F.col("below") == 0, F.col("parent"))).alias("parent"),
        first(f"{P}cNvPr", "id").alias("shape_id"), first(f"{P}cNvPr", "name").alias("shape_name"),
        *[first(f"{A}{t}", k, frame).try_cast("double").alias(n) for t, k, n in (("off", "x", "x"), ("off", "y", "y"), ("ext", "cx", "width"), ("ext", "cy", "height"))],
        first(f"{A}prstGeom", "prst").alias("preset"), first(f"{A}srgbClr", "val").alias("fill"),
        F.bool_or((F.col("tag") == f"{A}xfrm") & (F.col("below") == 2) & (F.coalesce(a["rot"], F.lit("0")) != "0")).alias("turned"),
        F.array_sort(F.collect_list(F.when(F.col("tag") == f"{A}t", F.struct("node", "paragraph", "text")))).alias("texts"), F.max("paragraph").alias("paragraphs"),
        F.array_sort(F.collect_list(F.when(~plain, F.struct("node", line.alias("line"))))).alias("lines"),
    )
    groups = slides.where(F.col("tag") == f"{P}grpSp").select("package", "name", "node", "parent")
    # Groups alone are nested; how deep is small, so their chains are few and short rows.
    key = lambda n: F.struct("package", "name", F.col(n).alias("node"))
    chains = ancestor_closure(groups.select(key("node").alias("id"), key("parent").alias("parent_id")))
    named = slides.where((F.col("tag") == f"{P}cNvPr") & (F.col("parent_tag") == f"{P}nvGrpSpPr")).select("package", "name", F.col("parent").alias("properties"), F.col("attributes")["name"].alias("group"))
    owners = slides.where(F.col("tag") == f"{P}nvGrpSpPr").select("package", "name", F.col("node").alias("properties"), F.col("parent").alias("node"))
    known = groups.join(_group_frames(slides), ["package", "name", "node"], "left").join(owners.join(named, ["package", "name", "properties"]).drop("properties"), ["package", "name", "node"], "left").drop("parent")
    every = chains.select("id", F.col("ancestor_id").alias("at"), "distance").unionByName(groups.select(key("node").alias("id"), key("node").alias("at"), F.lit(0).alias("distance")))
    step = every.select(F.col("id.package").alias("package"), F.col("id.name").alias("name"), F.col("id.node").alias("parent"), F.col("at.node").alias("node"), "distance").join(known, ["package", "name", "node"])
    around = step.groupBy("package", "name", "parent").agg(F.array_sort(F.collect_list(F.struct("distance", "group", "sx", "sy", "ox", "oy", "cx", "cy"))).alias("around"))
    return own.join(around, ["package", "name", "parent"], "left")


def slide_shapes(nodes: DataFrame) -> DataFrame:
    """``slide_objects`` from node rows, with the shape's elements from ``node`` to ``close`` and whether it is turned."""
    rows = _leaf_rows(nodes)
    gap = lambda t, i: t["paragraph"] - F.when(i == 0, F.lit(1)).otherwise(F.try_element_at("texts", F.greatest(i, F.lit(1)))["paragraph"])
    text = F.array_join(F.transform("texts", lambda t, i: F.concat(F.repeat(F.lit("\n"), gap(t, i).cast("int")), t["text"])), "")
    trail = F.repeat(F.lit("\n"), F.greatest(F.col("paragraphs") - F.coalesce(F.try_element_at("texts", F.lit(-1))["paragraph"], F.lit(1)), F.lit(0)).cast("int"))
    order = F.row_number().over(Window.partitionBy("package", "name").orderBy("node")) - 1
    residue = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return _in_slide(rows.withColumns({"ordinal": order, "text": F.concat(text, trail), "residue": residue}))


def _in_slide(rows: DataFrame) -> DataFrame:
    """Shapes with their frames as those of the slide, from their own frames and the groups around them."""
    no = F.coalesce("around", F.array().cast(rows.schema["around"].dataType))
    place = lambda c, s, o, b: F.aggregate(no, F.col(c), lambda v, g: (v - g[b]) * g[s] + g[o])
    extent = lambda c, s: F.aggregate(no, F.col(c), lambda v, g: v * g[s])
    units = lambda c, n: (c / F.lit(float(EMU))).alias(n)
    return rows.select(
        "package", "name", "ordinal", "shape_id", "shape_name", (F.col("tag") == f"{P}cxnSp").alias("connector"),
        units(place("x", "sx", "ox", "cx"), "x"), units(place("y", "sy", "oy", "cy"), "y"), units(extent("width", "sx"), "width"), units(extent("height", "sy"), "height"), "preset", "fill", "text",
        "residue", F.reverse(F.transform(no, lambda g: g["group"])).alias("groups"), F.substring_index("tag", "}", -1).alias("kind"), "node", "close", "turned", F.col("x").isNotNull().alias("framed"),
    )


def shapes_read(read: DataFrame) -> DataFrame:
    """``slide_shapes`` from the rows of ``slides.read_slides``."""
    number = lambda g, c: g[c].try_cast("double")
    scale = lambda g, e, w: F.when(number(g, w) > 0, number(g, e) / number(g, w))
    group = lambda g: F.struct(g["group"].alias("group"), scale(g, "ex", "wx").alias("sx"), scale(g, "ey", "wy").alias("sy"), *[number(g, c).alias(c) for c in ("ox", "oy", "cx", "cy")])
    rows = read.select("package", "name", F.explode("shapes").alias("s")).select("package", "name", "s.*")
    return _in_slide(rows.withColumns({"around": F.transform("around", group), **{c: F.col(c).try_cast("double") for c in ("x", "y", "width", "height")}}))


def slide_nodes(parts: DataFrame) -> DataFrame:
    """The node rows of the slides of packages, written, since what is known of a shape comes from several looks at them."""
    slides = parts.where(F.col("name").rlike(SLIDE)).select("package", "name", "content")
    return SharedTables(parts.sparkSession, "slides").cut("nodes", read_nodes(slides))


def slide_objects(parts: DataFrame) -> DataFrame:
    """(package, name, ordinal, shape_id, shape_name, connector, x, y, width, height, preset, fill, text, residue, groups): shapes of slides.

    Frames are those of the slide: coordinates inside groups pass through every group around them, from the innermost
    out; one inside a group without an extent has none. ``groups`` names the groups, outermost first. ``residue`` is what the
    markup says beyond numbers, names, frames, colours and plain paragraphs; shapes of equal residue differ in the other
    columns only. ``slide_refusals`` names what these columns do not tell.
    """
    slides = parts.where(F.col("name").rlike(SLIDE) & F.col("content").isNotNull())
    return shapes_read(read_slides(slides)).drop("kind", "node", "close", "turned", "framed").where(~F.col("shape_name").isNull())


def slide_refusals(parts: DataFrame) -> DataFrame:
    """(package, name, code, subject): objects that no operation can carry over: pictures, embedded frames, turned shapes,
    runs of unequal style in one shape, and shapes in groups that have no extent."""
    nodes = slide_nodes(parts)
    runs = T.anchored(nodes, F.col("tag") == f"{A}rPr").groupBy("package", "name", "anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", F.concat_ws(" ", "below", F.when(F.col("below") > 0, F.col("tag")), T.said()).alias("t")))), lambda x: x["t"]), "\n").alias("style"))
    shapes = T.held_by(nodes, "leaf").where(F.col("tag").isin(f"{A}r", f"{A}rPr")).select("package", "name", F.col("node").alias("anchor"), F.col("anchor").alias("node"), "tag")
    styles = shapes.join(runs, ["package", "name", "anchor"], "left").groupBy("package", "name", "node").agg(F.count_if(F.col("tag") == f"{A}r").alias("n_runs"), F.count("style").alias("n_styled"), F.count_distinct("style").alias("n_styles"))
    found = slide_shapes(nodes).join(styles, ["package", "name", "node"], "left")
    codes = F.array(
        F.when(F.col("kind") == "pic", "PICTURE"), F.when(F.col("kind") == "graphicFrame", "EMBEDDED-FRAME"), F.when(F.col("turned"), "TURNED"),
        F.when(F.col("framed") & F.col("x").isNull(), "GROUP-WITHOUT-EXTENT"), F.when((F.col("n_styles") > 1) | ((F.col("n_styles") == 1) & (F.col("n_styled") < F.col("n_runs"))), "UNEQUAL-RUNS"),
    )
    return found.select("package", "name", F.explode(F.array_compact(codes)).alias("code"), F.coalesce("shape_name", "kind").alias("subject"))


def object_identities(mapped: DataFrame, found: DataFrame) -> DataFrame:
    """(package, shape_name, n, status): mapped shapes as unique, missing or duplicate in a package."""
    n = found.groupBy("package", "shape_name").agg(F.count("*").alias("n"))
    out = mapped.select("package", "shape_name").join(n, ["package", "shape_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "unique").otherwise("duplicate"))
