"""Documents as rows: bytes, text, hashes, lengths, kind, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.scalars import utf16_length

# Limits of the format, and markup that a document may not have.
MAX_SOURCE_BYTES, MAX_ELEMENTS, MAX_DEPTH = 8 << 20, 100_000, 512
FORBIDDEN_ELEMENTS = ("script", "iframe", "object", "embed", "form", "foreignobject", "audio", "video")
URL_ATTRIBUTES = ("href", "src", "xlink:href", "srcset", "action", "xml:base")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, content) of every file below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")


def materialise(files: DataFrame, content_col: str = "content", max_bytes: int = MAX_SOURCE_BYTES) -> DataFrame:
    """Adds text, byte, code point and UTF-16 lengths, SHA-256 of the exact bytes, and a diagnostic code or null."""
    c = F.col(content_col)
    good = F.is_valid_utf8(c.cast("string"))
    text = F.when(good, F.decode(c, "UTF-8"))
    out = files.withColumn("text", text).withColumn("byte_len", F.octet_length(c).cast("long")).withColumn("sha256", F.sha2(c, 256))
    code = F.when(F.col("byte_len") > max_bytes, "SOURCE-TOO-LARGE").when(~good, "SOURCE-NOT-UTF8")
    return out.withColumn("char_len", F.length("text").cast("long")).withColumn("utf16_len", utf16_length("text")).withColumn("diagnostic", code)


def sniff_kind(text: Column | str) -> Column:
    """html, svg, manifest or unknown, by content; a byte order mark, XML prolog and comments before it do not count."""
    bare = F.ltrim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?s)^﻿?\s*(<\?xml[^>]*\?>\s*)?(<!--.*?-->\s*)*", ""))
    low = F.lower(F.left(bare, F.lit(64)))
    return F.when(low.rlike(r"^<!doctype html|^<html"), "html").when(low.rlike(r"^<svg[\s>]"), "svg").when(low.startswith("{"), "manifest").otherwise("unknown")


def line_starts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, byte_start): where each line begins, as running sums of line lengths."""
    parts = F.transform(F.split(text_col, "\n", -1), lambda l: F.octet_length(l) + 1)
    from pyspark.sql import Window

    rows = docs.select(id_col, F.posexplode(parts).alias("line", "size"))
    before = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(id_col, (F.col("line") + 1).alias("line"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("byte_start"))


#: A start tag: its end is the first > outside a quoted value. Possessive, so that a long tag is walked in a loop.
START_TAG = r"""<([A-Za-z](?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>"""
ATTRIBUTE = r"""([^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)"""


def tags(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, element, attributes): every start tag; a flat scan, which tag soup cannot break."""
    found = pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(START_TAG), F.lit(1))).alias("tag"))
    return found.select(id_col, F.lower(F.regexp_extract("tag", r"^([A-Za-z][A-Za-z0-9:-]*)", 1)).alias("element"), F.regexp_replace("tag", r"^[A-Za-z][A-Za-z0-9:-]*", "").alias("attributes"))


def attributes(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, element, name, value) of attributes in double, single or no quotes; one without a value has an empty one."""
    each = found.select(id_col, "element", F.explode(F.regexp_extract_all("attributes", F.lit(ATTRIBUTE), F.lit(1))).alias("a"))
    value = F.regexp_extract("a", r"(?s)^[^=]*=\s*(.*)$", 1)
    bare = F.when(value.rlike("""^["']"""), F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)
    return each.select(id_col, "element", F.lower(F.regexp_extract("a", r"^([^\s=]+)", 1)).alias("name"), bare.alias("value"))


def unsafe_url(value: Column) -> Column:
    """Only references within the document are safe."""
    return ~value.startswith("#")


def unsafe_css(value: Column) -> Column:
    """Also what a character reference may hide."""
    return F.lower(value).rlike(r"@import|\\|url\s*\(|image-set|&#")


def security_findings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, code, n): forbidden elements, event handlers, outside references and unsafe styles."""
    found = tags(pages, id_col, html_col)
    code = F.when(F.col("element").isin(*FORBIDDEN_ELEMENTS), "FORBIDDEN-ELEMENT")
    hits = found.select(id_col, code.alias("code"))
    a = attributes(found, id_col)
    code = F.when(F.col("name").rlike("^on"), "EVENT-HANDLER").when(F.col("name").isin(*URL_ATTRIBUTES) & unsafe_url(F.col("value")), "UNSAFE-URL").when((F.col("name") == "style") & unsafe_css(F.col("value")), "UNSAFE-CSS")
    return hits.unionByName(a.select(id_col, code.alias("code"))).where("code IS NOT NULL").groupBy(id_col, "code").agg(F.count("*").alias("n"))


def structure_limits(nodes: DataFrame, by: str, max_elements: int = MAX_ELEMENTS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Documents over a limit: refused, never cut."""
    out = nodes.groupBy(by).agg(F.count("*").alias("n_elements"), F.max("depth").alias("depth"))
    return out.where((F.col("n_elements") > max_elements) | (F.col("depth") > max_depth))


def fatal_documents(diagnostics: DataFrame, by: str = "doc_id") -> DataFrame:
    """Documents with an error or worse; an anti join withholds all their rows."""
    return diagnostics.where("severity IN ('error', 'fatal')").select(by).distinct()


def redact_private(values: Column, names: str = "password|secret|token|path", mask: str = "[redacted]") -> Column:
    """A map whose values under private names are masked."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike(names), mask).otherwise(v))
