"""Styles of word-processor packages: what each sets, what it inherits, and where headings drift from the body's look."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.objects import ancestor_closure
from docloom.sources import xml_tree as T
from docloom.sources.shared_tables import SharedTables

# The namespace, switches of the run properties, the words for off, font slots, and the styles looked at.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
STYLES = "word/styles.xml"
SWITCHES = ("b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "vanish")
OFF = ("0", "false", "off")
FONTS, THEME_FONTS = ("ascii", "hAnsi", "eastAsia", "cs"), ("asciiTheme", "hAnsiTheme", "eastAsiaTheme", "cstheme")
LEVELS = (1, 2, 3, 4)
#: The style that stands for the document's defaults.
DEFAULTS = ""
_COLUMNS = {**{f"font_{s}": f"rFonts.{s}" for s in FONTS}, **{f"theme_{s}": f"rFonts.{s}" for s in THEME_FONTS}, **{c: c for c in ("sz", "szCs", "b", "bCs", "i", "iCs", "color")}}


def declared_styles(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(styles, direct) from node rows: (package, style, kind, based_on, link), and (package, style, property, value) of what each
    sets itself. A switch is true or false; fonts are a property a slot. The defaults are the style ``DEFAULTS``."""
    here = nodes.where(F.col("name") == STYLES)
    a = lambda n: F.col("attributes")[f"{W}{n}"]
    styles = T.held_by(here, "holder")
    own = F.max(F.when(F.col("below") == 0, F.coalesce(a("styleId"), F.lit(DEFAULTS))))
    named = styles.groupBy("package", "anchor").agg(
        own.alias("style"), F.max(F.when(F.col("below") == 0, a("type"))).alias("kind"), *[F.max(F.when((F.col("below") == 1) & (F.col("tag") == f"{W}{t}"), a("val"))).alias(c) for t, c in (("basedOn", "based_on"), ("link", "link"))]
    ).where("style IS NOT NULL")
    local = F.substring_index("tag", "}", -1)
    runs = styles.where(F.col("parent_tag") == f"{W}rPr").where((F.col("below") == 2) | ((F.col("below") == 3) & (F.col("anchor_tag") == f"{W}docDefaults")))
    switch = F.when(F.lower(F.coalesce(a("val"), F.lit("1"))).isin(*OFF), "false").otherwise("true")
    single = F.array(F.struct(local.alias("property"), F.when(local.isin(*SWITCHES), switch).otherwise(F.coalesce(a("val"), F.lit("true"))).alias("value")))
    slots = F.transform(F.map_entries("attributes"), lambda e: F.struct(F.concat(F.lit("rFonts."), F.substring_index(e["key"], "}", -1)).alias("property"), e["value"].alias("value")))
    each = runs.select("package", "anchor", F.explode(F.when(local == "rFonts", slots).otherwise(single)).alias("p")).select("package", "anchor", "p.*")
    direct = each.join(named.select("package", "anchor", "style"), ["package", "anchor"]).groupBy("package", "style", "property").agg(F.max("value").alias("value"))
    return named.where(F.col("style") != DEFAULTS).select("package", "style", "kind", "based_on", "link"), direct


def resolved_styles(styles: DataFrame, direct: DataFrame) -> DataFrame:
    """(package, style, property, value, origin): what holds for each style after inheritance, and the style that says it.

    Chains of ``based_on`` are followed by pointer doubling. The nearest style that sets a property decides; a switch is on if
    an odd number of the chain's styles turn it on. The document's defaults (``origin`` is ``DEFAULTS``) hold where no style of
    the chain sets the property.
    """
    key = lambda c: F.struct("package", F.col(c).alias("style"))
    chains = ancestor_closure(styles.select(key("style").alias("id"), key("based_on").alias("parent_id")))
    every = chains.select("id.package", F.col("id.style").alias("of"), F.col("ancestor_id.style").alias("style"), "distance").unionByName(styles.select("package", F.col("style").alias("of"), "style", F.lit(0).alias("distance")))
    set_by = every.join(direct.where(F.col("style") != DEFAULTS), ["package", "style"])
    nearest = set_by.groupBy("package", F.col("of").alias("style"), "property").agg(F.min_by(F.struct("value", F.col("style").alias("origin")), "distance").alias("n"), (F.count_if(F.col("value") == "true") % 2 == 1).alias("odd"))
    own = nearest.select("package", "style", "property", F.when(F.col("property").isin(*SWITCHES), F.col("odd").cast("string")).otherwise(F.col("n.value")).alias("value"), F.col("n.origin").alias("origin"))
    base = direct.where(F.col("style") == DEFAULTS).select("package", "property", F.col("value").alias("base"))
    rest = styles.select("package", "style").join(base, "package").join(own.select("package", "style", "property"), ["package", "style", "property"], "left_anti")
    return own.unionByName(rest.select("package", "style", "property", F.col("base").alias("value"), F.lit(DEFAULTS).alias("origin")))


def _projected(styles: DataFrame, direct: DataFrame) -> DataFrame:
    """(package, style, s): a style with the run properties it sets itself, as one struct."""
    wide = direct.groupBy("package", "style").agg(*[F.max(F.when(F.col("property") == p, F.col("value"))).alias(c) for c, p in _COLUMNS.items()])
    return styles.join(wide, ["package", "style"], "left").select("package", "style", F.struct("kind", "based_on", "link", *_COLUMNS).alias("s"))


def _family(s: Column) -> Column:
    """The one family that all four slots name, or null."""
    slots = [s[f"font_{x}"] for x in FONTS]
    return F.when(reduce(Column.__and__, [x == slots[0] for x in slots]) & (slots[0] != ""), slots[0])


def _bare(s: Column, *columns: str) -> Column:
    return reduce(Column.__and__, [s[c].isNull() for c in columns])


def style_drift(styles: DataFrame, direct: DataFrame) -> DataFrame:
    """(package, style, property, verdict) of the body style and the headings: ``drift`` where a style does not itself say what
    it is expected to, and ``equivalent`` where it leaves fonts or slant out and its cascade is proven to give the same.

    The body is a paragraph style of no base and link with one family in all slots and one size. A heading stands on it, its
    character style on the default one, each links the other, both name the body's family, equal sizes and weights for both
    scripts, and no slant; and both agree. An omission is proven through an exact body, exact links, a character style that
    says the value, a neutral default character style, and (for slant) defaults that are upright. A missing style drifts.
    """
    projected = _projected(styles, direct)
    packages = styles.select("package").distinct()
    at = lambda style, name: projected.where(F.col("style") == style).select("package", F.col("s").alias(name))
    base = direct.where((F.col("style") == DEFAULTS) & F.col("property").isin("i", "iCs") & (F.col("value") == "true")).select("package", F.lit(True).alias("slanted")).distinct()
    found = packages.join(at("Normal", "n"), "package", "left").join(at("DefaultParagraphFont", "d"), "package", "left").join(base, "package", "left")
    n, d = F.col("n"), F.col("d")
    body = _family(n)
    themed = lambda s: ~_bare(s, *[f"theme_{x}" for x in THEME_FONTS])
    sized = lambda s: s["sz"].isNotNull() & s["sz"].eqNullSafe(s["szCs"])
    row = lambda style, prop, drifts, proven=None: F.struct(style.alias("style"), F.lit(prop).alias("property"), (F.when(proven, "equivalent") if proven is not None else F).when(drifts, "drift").alias("verdict"))
    normal = F.lit("Normal")
    own = F.when(n.isNull(), F.array(row(normal, "presence", F.lit(True)))).otherwise(F.array(
        row(normal, "styleType", ~n["kind"].eqNullSafe("paragraph")), row(normal, "basedOn", n["based_on"].isNotNull()), row(normal, "link", n["link"].isNotNull()),
        row(normal, "explicitFonts", body.isNull()), row(normal, "themeFonts", themed(n)), row(normal, "sizeHalfPoints", ~sized(n)),
    ))
    exact_base = F.coalesce(n["kind"].eqNullSafe("paragraph") & _bare(n, "based_on", "link") & body.isNotNull() & ~themed(n), F.lit(False))
    neutral = F.coalesce(d["kind"].eqNullSafe("character") & _bare(d, "based_on", "link", *_COLUMNS), F.lit(False))
    upright = ~F.coalesce(F.col("slanted"), F.lit(False)) | (n["i"].eqNullSafe("false") & n["iCs"].eqNullSafe("false"))
    upright = upright & ~F.coalesce((n["i"] == "true") | (n["iCs"] == "true"), F.lit(False))

    heads = found.select("package", "n", "d", exact_base.alias("exact"), neutral.alias("neutral"), upright.alias("upright"), body.alias("body"), F.explode(F.lit([f"Heading{k}" for k in LEVELS])).alias("head"))
    heads = heads.join(projected.select("package", F.col("style").alias("head"), F.col("s").alias("p")), ["package", "head"], "left")
    heads = heads.withColumn("mark", F.concat("head", F.lit("Char"))).join(projected.select("package", F.col("style").alias("mark"), F.col("s").alias("c")), ["package", "mark"], "left")
    p, c, head, mark = F.col("p"), F.col("c"), F.col("head"), F.col("mark")
    both = p.isNotNull() & c.isNotNull()
    links = p["link"].eqNullSafe(mark) & c["link"].eqNullSafe(head)
    proof = F.coalesce(both & F.col("exact") & F.col("neutral") & links & p["kind"].eqNullSafe("paragraph") & p["based_on"].eqNullSafe("Normal") & ~themed(p) & c["kind"].eqNullSafe("character") & c["based_on"].eqNullSafe("DefaultParagraphFont") & _family(c).eqNullSafe(F.col("body")) & ~themed(c), F.lit(False))
    is_flat = lambda s: s["i"].eqNullSafe("false") & s["iCs"].eqNullSafe("false")
    by_fonts, by_slant = proof & _bare(p, *[f"font_{x}" for x in FONTS]), proof & _bare(p, "i", "iCs") & is_flat(c) & F.col("upright")
    foreign = lambda s: _family(s).isNull() | (F.col("body").isNotNull() & (_family(s) != F.col("body")))
    differ = [~p[x].eqNullSafe(c[x]) for x in ("sz", "szCs", "b", "bCs", "color", *[f"theme_{t}" for t in THEME_FONTS])]
    differ += [~F.when(by_fonts, n[f"font_{x}"]).otherwise(p[f"font_{x}"]).eqNullSafe(c[f"font_{x}"]) for x in FONTS] + [~F.when(by_slant, F.lit("false")).otherwise(p[x]).eqNullSafe(c[x]) for x in ("i", "iCs")]

    def one(s: Column, name: Column, kind: str, parent: str, fonts: Column | None, slant: Column | None) -> Column:
        shaped = F.array(row(name, "styleType", ~s["kind"].eqNullSafe(kind)), row(name, "basedOn", ~s["based_on"].eqNullSafe(parent)), row(name, "explicitFonts", foreign(s), fonts), row(name, "italic", ~is_flat(s), slant),
                         row(name, "themeFonts", themed(s)), row(name, "sizeHalfPoints", ~sized(s)), row(name, "bold", s["b"].isNull() | ~s["b"].eqNullSafe(s["bCs"])))
        return F.when(s.isNull(), F.array(row(name, "presence", F.lit(True)))).otherwise(shaped)

    pairs = F.when(both, F.array(row(head, "linkedCharacterAgreement", reduce(Column.__or__, differ)), row(head, "link", ~p["link"].eqNullSafe(mark)), row(mark, "link", ~c["link"].eqNullSafe(head))))
    told = F.concat(one(p, head, "paragraph", "Normal", by_fonts, by_slant), one(c, mark, "character", "DefaultParagraphFont", None, None), F.coalesce(pairs, F.array().cast("array<struct<style:string,property:string,verdict:string>>")))
    rows = found.select("package", F.explode(own).alias("r")).unionByName(heads.select("package", F.explode(told).alias("r")))
    return rows.select("package", "r.*").where("verdict IS NOT NULL")


def read_styles(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``declared_styles`` of packages (package, name, content); both results are written."""
    tables = SharedTables(parts.sparkSession, "styles")
    nodes = tables.cut("nodes", T.read_elements(parts.where(F.col("name") == STYLES), anchors={"holder": (f"{W}style", f"{W}docDefaults")}))
    styles, direct = declared_styles(nodes)
    return tables.cut("styles", styles), tables.cut("direct", direct)
