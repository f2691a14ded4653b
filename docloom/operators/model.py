"""Validation and resolution of parsed documents: all diagnostics first, then one gate that withholds bad documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import STABLE_ID, escape_xml, first_given
from docloom.operators.styles import cascade, group_bounds, style_text
from docloom.sources.markup import EXPORT_MODES, ROLE_ELEMENTS


def _found(df: DataFrame, code: str, subject, severity: str = "error") -> DataFrame:
    return df.select("doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def validate(nodes: DataFrame, slides: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, severity, code, subject): what is wrong with documents, each finding a row."""
    named = nodes.where("id IS NOT NULL")
    allowed = F.create_map(*[x for r, e in ROLE_ELEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, e)))])
    slide = sections.where("kind = 'slide'").select("doc_id", F.col("name").alias("scope_id"))
    n = slide.groupBy("doc_id", "scope_id").agg(F.count("*").alias("n"))
    themes = sections.where("kind = 'theme'").select("doc_id", F.col("name").alias("theme")).distinct()
    ends = named.where("role = 'connector'").select("doc_id", "id", F.explode(F.array(F.col("attributes")["from"], F.col("attributes")["to"])).alias("end")).where("end IS NOT NULL")
    many = F.count("*").over(Window.partitionBy("doc_id", "id"))
    out = [
        _found(nodes.where("id IS NULL"), "ID-MISSING", F.col("element")),
        _found(named.where(~F.col("id").rlike(STABLE_ID)), "ID-GRAMMAR", F.col("id")),
        _found(named.withColumn("_n", many).where("_n > 1").select("doc_id", "id").distinct(), "ID-DUPLICATE", F.col("id")),
        _found(nodes.where(~F.col("role").isin(*ROLE_ELEMENTS)), "ROLE-UNKNOWN", F.col("role")),
        _found(nodes.where(~F.col("export_mode").isin(*EXPORT_MODES)), "EXPORT-UNKNOWN", F.col("export_mode")),
        _found(nodes.where((F.col("export_mode") == "native") & F.col("role").isin(*ROLE_ELEMENTS) & ~F.array_contains(allowed[F.col("role")], F.col("element"))), "ROLE-ELEMENT", F.col("id")),
        _found(ends.join(named.select("doc_id", F.col("id").alias("end")).distinct(), ["doc_id", "end"], "left_anti"), "ENDPOINT-MISSING", F.col("id")),
        _found(slides.join(n, ["doc_id", "scope_id"], "left").where("coalesce(n, 0) <> 1"), "SLIDE-REFERENCE", F.col("scope_id")),
        _found(slide.join(slides, ["doc_id", "scope_id"], "left_anti").distinct(), "SLIDE-UNUSED", F.col("scope_id"), "warning"),
        _found(slides.where("theme IS NOT NULL").select("doc_id", "theme").distinct().join(themes, ["doc_id", "theme"], "left_anti"), "THEME-REFERENCE", F.col("theme")),
    ]
    all_found = out[0]
    for o in out[1:]:
        all_found = all_found.unionByName(o)
    return all_found


def gated(rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Rows of documents without an error: an error withholds its whole document."""
    return rows.join(diagnostics.where("severity IN ('error', 'fatal')").select("doc_id").distinct(), "doc_id", "left_anti")


def rendered(nodes: DataFrame) -> DataFrame:
    """Objects that are exported, siblings numbered anew after the ignored ones (and all below them) are gone."""
    gone = nodes.where("export_mode = 'ignore'").select("doc_id", F.col("id").alias("_g"))
    below = nodes.select("doc_id", "id", F.explode("ancestor_ids").alias("_g")).join(gone, ["doc_id", "_g"], "left_semi").select("doc_id", "id")
    kept = nodes.where("export_mode <> 'ignore'").join(below, ["doc_id", "id"], "left_anti")
    order = Window.partitionBy("doc_id", "scope_id", "parent_id").orderBy("preorder")
    return kept.withColumn("sibling_order", F.row_number().over(order) - 1)


def local_bounds(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, ancestor_ids, x, y, width, height) of objects with a geometry of their own, offsets of groups added."""
    a = lambda n: F.coalesce(F.col("attributes")[n].try_cast("double"), F.lit(0.0))
    frame = F.transform(F.split(F.trim(F.col("attributes")["frame"]), r"\s+"), lambda t: t.try_cast("double"))
    e = F.col("element")
    x = F.when(e == "circle", a("cx") - a("r")).when(e == "ellipse", a("cx") - a("rx")).when(e == "line", F.least(a("x1"), a("x2"))).when(e == "text", frame[0]).otherwise(a("x"))
    y = F.when(e == "circle", a("cy") - a("r")).when(e == "ellipse", a("cy") - a("ry")).when(e == "line", F.least(a("y1"), a("y2"))).when(e == "text", frame[1]).otherwise(a("y"))
    w = F.when(e == "circle", a("r") * 2).when(e == "ellipse", a("rx") * 2).when(e == "line", F.abs(a("x1") - a("x2"))).when(e == "text", frame[2]).otherwise(a("width"))
    h = F.when(e == "circle", a("r") * 2).when(e == "ellipse", a("ry") * 2).when(e == "line", F.abs(a("y1") - a("y2"))).when(e == "text", frame[3]).otherwise(a("height"))
    leaves = nodes.where("role <> 'group'").withColumns({"x": x, "y": y, "width": w, "height": h})
    move = r"^translate\(\s*([-+0-9.eE]+)(?:[\s,]+([-+0-9.eE]+))?\s*\)$"
    given = F.col("attributes")["transform"]
    part = lambda k: F.coalesce(F.regexp_extract(given, move, k).try_cast("double"), F.lit(0.0))
    moves = nodes.where(given.rlike(move)).select("doc_id", F.col("id").alias("_a"), part(1).alias("tx"), part(2).alias("ty"))
    steps = leaves.select("doc_id", "id", F.posexplode("ancestor_ids").alias("k", "_a")).join(moves, ["doc_id", "_a"])
    shift = steps.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("k", "tx", "ty"))).alias("s"))
    total = lambda c: F.aggregate(F.coalesce("s", F.array().cast("array<struct<k:int,tx:double,ty:double>>")), F.lit(0.0), lambda v, t: v + t[c])
    both = leaves.join(shift, ["doc_id", "id"], "left")
    return both.select("doc_id", "id", "ancestor_ids", (F.col("x") + total("tx")).alias("x"), (F.col("y") + total("ty")).alias("y"), "width", "height")


def resolve(nodes: DataFrame, rules: DataFrame, tokens: DataFrame, theme: str) -> tuple[DataFrame, DataFrame]:
    """(bounds, styles) of the rendered objects of documents, by doc_id and id: world rectangles, groups as unions, and
    styles cascaded from the document's own rules and theme."""
    live = rendered(nodes)
    leaves = local_bounds(live)
    groups = group_bounds(leaves.select("doc_id", "ancestor_ids", "x", "y", "width", "height"), ("doc_id",))
    bounds = leaves.select("doc_id", "id", "x", "y", "width", "height").unionByName(groups)
    presentational = F.map_filter("attributes", lambda k, v: k.isin("fill", "stroke", "stroke-width", "opacity", "font-size", "font-weight", "font-style", "font-family", "text-anchor"))
    inline = F.coalesce(F.map_from_entries(F.transform(F.filter(F.split(F.col("attributes")["style"], ";"), lambda d: F.contains(d, F.lit(":"))), lambda d: F.struct(F.trim(F.split(d, ":")[0]).alias("k"), F.trim(F.split(d, ":")[1]).alias("v")))), F.create_map().cast("map<string,string>"))
    styled = live.select("doc_id", "id", "classes", presentational.alias("attributes"), inline.alias("inline"))
    return bounds, cascade(styled, rules, tokens.where(F.col("theme_id") == theme).select("doc_id", "token", "expression"), ("doc_id",))


def hydrate(nodes: DataFrame, styles: DataFrame, scope_id: str) -> DataFrame:
    """(doc_id, scope_id, markup): one slide as a document of its own, with resolved styles inline instead of classes.

    Texts and values were decoded when they were read, so they are escaped anew.
    """
    rows = nodes.where(F.col("scope_id") == scope_id).join(style_text(styles, ("doc_id",)), ["doc_id", "id"], "left")
    own = F.array_sort(F.map_entries(F.map_filter("attributes", lambda k, v: ~k.isin("class", "style", "layout"))))
    kept = F.array_join(F.transform(own, lambda e: F.concat(e["key"], F.lit('="'), escape_xml(e["value"], attribute=True), F.lit('"'))), " ")
    style = escape_xml(F.coalesce("style", F.lit("")), attribute=True)
    tag = F.concat(F.lit("<"), "element", F.lit(" "), kept, F.lit(' style="'), style, F.lit('">'), escape_xml(F.coalesce("text", F.lit(""))), F.lit("</"), "element", F.lit(">"))
    return rows.withColumn("tag", tag).groupBy("doc_id", "scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "tag"))), lambda r: r["tag"]), "\n").alias("markup"))


def role_element_mismatches(nodes: DataFrame) -> DataFrame:
    """Objects whose role is unknown, or whose element the role may not use."""
    allowed = F.create_map(*[x for r, e in ROLE_ELEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, e)))])
    return nodes.where(~F.coalesce(F.array_contains(allowed[F.col("role")], F.col("element")), F.lit(False)))


def compare_metadata(left: DataFrame, right: DataFrame, key: str, ladder: dict[str, str]) -> DataFrame:
    """(key, verdict) of each left row: missing without a right one, else what the first differing column of the ladder
    (column to verdict) says, else equal."""
    both = left.select(key, *[F.col(c).alias(f"l_{c}") for c in ladder]).join(right.select(key, F.lit(True).alias("there"), *[F.col(c).alias(f"r_{c}") for c in ladder]), key, "left")
    steps = [F.when(F.col("there").isNull(), "missing"), *[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), verdict) for c, verdict in ladder.items()]]
    return both.select(key, first_given(*steps, F.lit("equal")).alias("verdict"))


def with_faces(lines: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines with the font face that fits family, weight and style; without one they stay unmeasured."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, "[\"']", "")))
    f = faces.select(key(F.col("family")).alias("_family"), F.col("weight").alias("_weight"), F.col("style").alias("_style"), "face")
    cond = (key(F.col("family")) == F.col("_family")) & (F.col("weight") == F.col("_weight")) & (F.col("style") == F.col("_style"))
    return lines.join(f, cond, "left").drop("_family", "_weight", "_style")
