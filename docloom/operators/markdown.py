"""Markdown documents as lines and blocks: windows over lines, no parser loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import demote_links, normalise_newlines

# How each kind of line begins.
STARTS = [
    ("comment", r"^<!--.*-->$"),
    ("rule", r"^-{3,}$"),
    ("table", r"^[|]"),
    ("blockquote", r"^>"),
    ("heading", r"^#{1,4}\s"),
    ("bullet", r"^[-*]\s"),
    ("numbered", r"^[0-9]+[.]\s"),
]
_ALONE = ("heading", "bullet", "numbered", "banner")
_DROPPED = ("blank", "comment", "rule", "fence")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line, raw, kind, inside): every line with its kind; fence parity says which are code."""
    raw = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(normalise_newlines(text_col), "\n", -1)).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    bare = F.trim("raw")
    by = Window.partitionBy("doc_id").orderBy("line")
    fence = (bare == "```").cast("int")
    out = raw.withColumn("fences", F.coalesce(F.sum(fence).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("inside", F.col("fences") % 2 == 1)
    out = out.withColumn("first", F.min(F.when(bare != "", F.col("line"))).over(Window.partitionBy("doc_id")))
    kind = F.when(bare == "```", "fence").when(F.col("inside"), "code").when(bare == "", "blank")
    kind = kind.when((F.col("line") == F.col("first")) & bare.rlike(r"^[*][*]CUI[^*]*[*][*]$"), "banner")
    for name, pattern in STARTS:
        kind = kind.when(bare.rlike(pattern), name)
    return out.withColumn("kind", kind.otherwise("paragraph")).drop("first")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, kind, level, value, line): runs of lines of one kind; headings and list items stand alone.

    An empty fenced block has no code line and so no block of its own; its fences still close what is before them.
    """
    by = Window.partitionBy("doc_id").orderBy("line")
    marked = lines(docs, id_col, text_col)
    new = F.col("kind").isin(*_ALONE) | ~F.lag("kind").over(by).eqNullSafe(F.col("kind")) | (F.lag("fences").over(by) != F.col("fences"))
    runs = marked.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(by)).where(~F.col("kind").isin(*_DROPPED))
    bare = F.trim("raw")
    content = (
        F.when(F.col("kind") == "code", F.rtrim("raw"))
        .when(F.col("kind") == "heading", F.regexp_replace(bare, r"^#+\s+", ""))
        .when(F.col("kind") == "bullet", F.regexp_replace(bare, r"^[-*]\s+", ""))
        .when(F.col("kind") == "blockquote", F.trim(F.substring(bare, 2, 2**30)))
        .when(F.col("kind") == "banner", F.regexp_replace(bare, "[*]", ""))
        .otherwise(bare)
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(bare, "^(#+)", 1)))
    parts = runs.withColumn("content", content).withColumn("level", level).groupBy("doc_id", "run").agg(
        F.first("kind").alias("kind"), F.max("level").alias("level"), F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "content"))).alias("parts")
    )
    contents = F.transform("parts", lambda p: p["content"])
    joined = F.when(F.col("kind").isin("code", "table"), F.array_join(contents, "\n")).otherwise(F.array_join(contents, " "))
    value = F.when(F.col("kind") == "code", joined).otherwise(demote_links(joined))
    return parts.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1).alias("ordinal"), "kind", "level", value.alias("value"), "line")


def table_cells(row):
    """The cells of a pipe row, escaped pipes kept."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(row), r"^[|]", ""), r"(?<!\\)[|]$", "")
    return F.transform(F.split(inner, r"(?<!\\)[|]"), lambda c: F.trim(c))


def canonical(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, markdown): one spelling of the supported constructs, blocks parted by an empty line."""
    rows = F.split("value", "\n")
    dressed = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(table_cells(r), " | "), F.lit(" |")))
    text = (
        F.when(F.col("kind") == "banner", F.concat(F.lit("**"), "value", F.lit("**")))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "value"))
        .when(F.col("kind") == "bullet", F.concat(F.lit("- "), "value"))
        .when(F.col("kind") == "blockquote", F.concat(F.lit("> "), "value"))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), "value", F.lit("\n```")))
        .when(F.col("kind") == "table", F.array_join(dressed, "\n"))
        .otherwise(F.col("value"))
    )
    found = blocks(docs, id_col, text_col).withColumn("text", text).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("b"))
    out = F.concat(F.rtrim(F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")), F.lit("\n"))
    return docs.select(F.col(id_col).alias("doc_id")).join(found.select("doc_id", out.alias("markdown")), "doc_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("\n")))


def refusals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, code): constructs that the canonical form would lose, each as a diagnostic row."""
    bare = F.trim("raw")
    by = Window.partitionBy("doc_id").orderBy("line")
    marked = lines(docs, id_col, text_col).withColumn("next", F.lead("raw").over(by)).withColumn("total", F.sum((bare == "```").cast("int")).over(Window.partitionBy("doc_id")))
    free = ~F.col("inside") & ~F.col("kind").isin("fence", "blank")
    tests = [
        ("IMAGE", free & F.col("raw").rlike(r"!\[")),
        ("INDENTED-CODE", free & F.col("raw").rlike(r"^(\t| {4})") & ~bare.rlike(r"^([-*]|[0-9]+[.])\s")),
        ("NESTED-LIST", free & F.col("raw").rlike(r"^\s+([-*]|[0-9]+[.])\s")),
        ("HARD-BREAK", free & F.col("raw").rlike(r"(  |\\)$")),
        ("SETEXT-HEADING", free & (F.col("kind") == "paragraph") & F.col("next").rlike(r"^ {0,3}(=+|-+)[ \t]*$")),
        ("HEADING-LEVEL", free & bare.rlike(r"^#{5,}\s")),
        ("HTML-COMMENT", free & bare.rlike(r"^<!--") & ~bare.rlike(r"-->$")),
        ("FENCE-INFO", free & bare.rlike(r"^```.+")),
        ("NESTED-BLOCKQUOTE", free & bare.rlike(r"^>\s*>")),
        ("UNCLOSED-FENCE", (F.col("kind") == "fence") & (F.col("total") % 2 == 1) & (F.col("fences") == F.col("total") - 1)),
    ]
    hits = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests]), lambda c: c.isNotNull())
    return marked.select("doc_id", "line", F.explode(hits).alias("code"))


def inline_segments(value):
    """(style, text) in order: code, bold, italic or plain."""
    token = r"(`[^`]+`|[*][*][^*]+[*][*]|[*][^*]+[*]|[^`*]+|[`*])"
    style = lambda t: F.when(t.rlike("^`.+`$"), "code").when(t.rlike(r"^[*][*].+[*][*]$"), "bold").when(t.rlike(r"^[*].+[*]$"), "italic").otherwise("plain")
    return F.transform(F.regexp_extract_all(value, F.lit(token), F.lit(1)), lambda t: F.struct(style(t).alias("style"), F.regexp_replace(t, r"^(`|[*]{1,2})(.+)\1$", "$2").alias("text")))
