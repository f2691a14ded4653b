"""Markdown blocks as word-processor packages and back, with the source embedded and every part accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import escape_xml, unescape_xml, wrap_marker
from docloom.operators.markdown import blocks, canonical, inline_segments, table_cells
from docloom.sources import xml_tree

# Paragraph styles by block, run properties by style, names of parts, and constructs that would be lost.
STYLES = {"banner": "Banner", "bullet": "ListBullet", "numbered": "ListNumber", "blockquote": "Quote", "code": "CodeBlock", "paragraph": "Normal"}
RUNS = {"bold": "<w:b/>", "italic": "<w:i/>", "code": '<w:rStyle w:val="CodeChar"/>', "plain": ""}
BODY, SOURCE = "word/document.xml", "customXml/item1.xml"
STATIC = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/customXml" Target="../customXml/item1.xml"/></Relationships>',
}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REFUSED = {"REVISION": ("ins", "del", "moveFrom", "moveTo"), "NUMBERING": ("numPr",), "DRAWING": ("drawing", "pict", "object"), "FIELD": ("fldSimple", "fldChar"), "NOTE": ("footnoteReference", "endnoteReference", "commentReference")}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in d.items() for x in p])


def _runs(value: Column, plain: bool = False) -> Column:
    one = lambda style, text: F.concat(F.lit("<w:r><w:rPr>"), _map(RUNS)[style], F.lit('</w:rPr><w:t xml:space="preserve">'), escape_xml(text), F.lit("</w:t></w:r>"))
    return one(F.lit("plain"), value) if plain else F.array_join(F.transform(inline_segments(value), lambda s: one(s["style"], s["text"])), "")


def _paragraph(style: Column, runs: Column) -> Column:
    return F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="'), style, F.lit('"/></w:pPr>'), runs, F.lit("</w:p>"))


def to_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(package, name, content): the parts of one package a document; ``packages.write_packages`` archives them."""
    style = F.when(F.col("kind") == "heading", F.concat(F.lit("Heading"), F.col("level").cast("string"))).otherwise(_map(STYLES)[F.col("kind")])
    rows = F.split("value", "\n")
    code = F.array_join(F.transform(rows, lambda r: _paragraph(F.lit("CodeBlock"), _runs(r, plain=True))), "")
    cells = lambda r: F.array_join(F.transform(table_cells(r), lambda c: F.concat(F.lit("<w:tc>"), _paragraph(F.lit("Normal"), _runs(c)), F.lit("</w:tc>"))), "")
    kept = F.filter(rows, lambda r, i: i != 1)
    table = F.concat(F.lit("<w:tbl>"), F.array_join(F.transform(kept, lambda r: F.concat(F.lit("<w:tr>"), cells(r), F.lit("</w:tr>"))), ""), F.lit("</w:tbl>"))
    xml = F.when(F.col("kind") == "code", code).when(F.col("kind") == "table", table).otherwise(_paragraph(style, _runs(F.col("value"))))
    found = blocks(docs, id_col, text_col).select("doc_id", F.struct("ordinal", xml.alias("xml")).alias("b")).groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    body = F.concat(F.lit('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'), F.coalesce(F.array_join(F.transform("b", lambda x: x["xml"]), ""), F.lit("")), F.lit("</w:body></w:document>"))
    text = canonical(docs, id_col, text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    item = F.concat(F.lit('<source><original sha256="'), F.sha2("_t", 256), F.lit('">'), _plain64(F.col("_t")), F.lit('</original><canonical sha256="'), F.sha2("markdown", 256), F.lit('">'), _plain64(F.col("markdown")), F.lit("</canonical></source>"))
    per = source.join(text, "doc_id").join(found, "doc_id", "left").select("doc_id", body.alias("_body"), item.alias("_item"))
    parts = F.array(F.struct(F.lit(BODY).alias("name"), F.col("_body").alias("t")), F.struct(F.lit(SOURCE).alias("name"), F.col("_item").alias("t")), *[F.struct(F.lit(n).alias("name"), F.lit(t).alias("t")) for n, t in STATIC.items()])
    return per.select(F.col("doc_id").cast("string").alias("package"), F.explode(parts).alias("p")).select("package", "p.name", F.encode("p.t", "UTF-8").alias("content"))


def _plain64(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def embedded_source(parts: DataFrame) -> DataFrame:
    """(package, original, markdown, problem): the source a package carries; both hashes must hold."""
    xml = F.decode("content", "UTF-8")
    got = lambda n: F.decode(F.unbase64(F.regexp_extract(xml, rf'<{n} sha256="[0-9a-f]*">([^<]*)</{n}>', 1)), "UTF-8")
    said = lambda n: F.regexp_extract(xml, rf'<{n} sha256="([0-9a-f]*)">', 1)
    bad = (F.sha2("original", 256) != F.col("_o")) | (F.sha2("markdown", 256) != F.col("_c"))
    problem = F.when(F.col("_o").isNull(), "SOURCE-MISSING").when(bad, "SOURCE-CHANGED").alias("problem")
    read = parts.withColumn("_is", F.col("name") == SOURCE).select("package", "_is", *[F.when(F.col("_is"), c).alias(n) for n, c in (("original", got("original")), ("markdown", got("canonical")), ("_o", said("original")), ("_c", said("canonical")))])
    # A package without a source has a row too: the parts are looked at once, not once to name the packages and once to read.
    sources = read.groupBy("package").agg(F.collect_list(F.when(F.col("_is"), F.struct("original", "markdown", problem))).alias("_s"))
    return sources.select("package", F.explode_outer("_s").alias("_s")).select("package", "_s.original", "_s.markdown", F.when(F.col("_s").isNull(), "SOURCE-MISSING").otherwise(F.col("_s.problem")).alias("problem"))


def _inline(xml: Column) -> Column:
    """Text of a paragraph; neighbouring runs of one style become one, then get their markers."""
    seg = F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?s)(<w:r[ >].*?</w:r>)"), F.lit(1)),
        lambda r: F.struct(
            F.when(r.rlike(r'<w:rStyle w:val="CodeChar"/>'), "code").when(r.rlike(r"<w:b/>"), "bold").when(r.rlike(r"<w:i/>"), "italic").otherwise("plain").alias("style"),
            unescape_xml(F.array_join(F.regexp_extract_all(r, F.lit(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1)), "")).alias("text"),
        ),
    )
    none = F.array().cast("array<struct<style:string,text:string>>")
    last = lambda a: F.element_at(a, -1)
    grow = lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["style"] == s["style"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(s["style"].alias("style"), F.concat(last(a)["text"], s["text"]).alias("text"))))).otherwise(F.concat(a, F.array(s)))
    merged = F.aggregate(seg, none, grow)
    dressed = lambda s: F.when(s["style"] == "bold", wrap_marker(s["text"], "**")).when(s["style"] == "italic", wrap_marker(s["text"], "*")).when(s["style"] == "code", wrap_marker(s["text"], "`")).otherwise(s["text"])
    return F.array_join(F.transform(merged, dressed), "")


def to_markdown(parts: DataFrame) -> DataFrame:
    """(package, markdown): what the body of each package says; consecutive code paragraphs are one block."""
    body = parts.where(F.col("name") == BODY).select("package", F.decode("content", "UTF-8").alias("xml"))
    items = body.select("package", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)(<w:tbl[ >].*?</w:tbl>|<w:p[ >].*?</w:p>)"), F.lit(1))).alias("k", "x"))
    style = F.regexp_extract("x", r'<w:pStyle w:val="([^"]*)"', 1)
    table_rows = F.transform(F.regexp_extract_all("x", F.lit(r"(?s)(<w:tr[ >].*?</w:tr>)"), F.lit(1)), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?s)(<w:tc[ >].*?</w:tc>)"), F.lit(1)), _inline), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.regexp_extract_all(F.regexp_extract("x", r"(?s)(<w:tr[ >].*?</w:tr>)", 1), F.lit(r"(<w:tc[ >])"), F.lit(1)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.slice(table_rows, 1, 1), F.array(rule), F.slice(table_rows, 2, 2**30)), "\n")
    text = _inline(F.col("x"))
    said = (
        F.when(F.col("x").startswith("<w:tbl"), table)
        .when(style.rlike("^Heading[1-4]$"), F.concat(F.repeat(F.lit("#"), F.substring(style, 8, 1).try_cast("int")), F.lit(" "), text))
        .when(style == "Banner", F.concat(F.lit("**"), text, F.lit("**")))
        .when(style == "ListBullet", F.concat(F.lit("- "), text))
        .when(style == "Quote", F.concat(F.lit("> "), text))
        .otherwise(text)
    )
    code = style == "CodeBlock"
    marked = items.select("package", "k", code.alias("code"), said.alias("said"))
    by = Window.partitionBy("package").orderBy("k")
    runs = marked.withColumn("new", (~F.col("code")) | ~F.coalesce(F.lag("code").over(by), F.lit(False))).withColumn("run", F.sum(F.col("new").cast("int")).over(by))
    joined = runs.groupBy("package", "run").agg(F.bool_and("code").alias("code"), F.array_sort(F.collect_list(F.struct("k", "said"))).alias("p"))
    lines = F.array_join(F.transform("p", lambda x: x["said"]), "\n")
    out = joined.select("package", F.struct("run", F.when(F.col("code"), F.concat(F.lit("```\n"), lines, F.lit("\n```"))).otherwise(lines).alias("t")).alias("b")).groupBy("package").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return out.select("package", F.concat(F.rtrim(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n")), F.lit("\n")).alias("markdown"))


def refusals(parts: DataFrame) -> DataFrame:
    """(package, name, code): constructs that Markdown would lose, by their expanded names, whatever the prefix."""
    codes = F.create_map(*[F.lit(x) for code, tags in REFUSED.items() for t in tags for x in (WORD + t, code)])
    nodes = xml_tree.read_elements(parts.where("name LIKE 'word/%.xml' AND content IS NOT NULL"))
    return nodes.select("package", "name", codes[F.col("tag")].alias("code")).where("code IS NOT NULL").distinct()


def inverted(parts: DataFrame) -> DataFrame:
    """(package, markdown, proven): the Markdown of each package, and whether its canonical form is itself."""
    said = to_markdown(parts)
    again = canonical(said, "package", "markdown").select(F.col("doc_id").alias("package"), F.col("markdown").alias("_again"))
    return said.join(again, "package").select("package", "markdown", F.col("markdown").eqNullSafe(F.col("_again")).alias("proven"))
