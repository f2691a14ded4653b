"""Word-processor styles over the driver tables: chains of inheritance, and headings that drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import word_styles as S
from docloom.plans.registry import query, table
from docloom.sources import packages as P

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _packages(rows, body):
    xml = F.concat(F.lit(f"<w:styles {WORD}>"), body, F.lit("</w:styles>"))
    return rows.select("package", F.lit(S.STYLES).alias("name"), F.encode(xml, "UTF-8").alias("content"))


@query("p13_c34_w13_style_inheritance", """WITH c AS (SELECT c_custkey, 'p' || c_custkey AS package, c_custkey % 40 + 1 AS n FROM customer), s AS (SELECT package, n, unnest(range(0, n)) AS k FROM c)
SELECT package, 's' || k AS style, 'sz' AS property, (k - k % 3)::VARCHAR AS value, 's' || (k - k % 3) AS origin FROM s
UNION ALL SELECT package, 's' || k, 'b', CASE WHEN (k // 2 + 1) % 2 = 1 THEN 'true' ELSE 'false' END, 's' || (k - k % 2) FROM s
UNION ALL SELECT package, 's' || k, 'color', CASE WHEN k >= 5 THEN 'FF0000' ELSE '00FF00' END, CASE WHEN k >= 5 THEN 's5' ELSE '' END FROM s""")
def inheritance(spark, sf):
    """A chain of up to 40 styles a customer: every third sets a size, every second turns bold on, one a colour."""
    rows = table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("package"), (F.col("c_custkey") % 40 + 1).cast("int").alias("n"))
    own = lambda k: F.concat(F.when(k % 3 == 0, F.concat(F.lit('<w:sz w:val="'), k.cast("string"), F.lit('"/>'))).otherwise(""), F.when(k % 2 == 0, "<w:b/>").otherwise(F.lit("")), F.when(k == 5, '<w:color w:val="FF0000"/>').otherwise(""))
    base = lambda k: F.when(k > 0, F.concat(F.lit('<w:basedOn w:val="s'), (k - 1).cast("string"), F.lit('"/>'))).otherwise("")
    style = lambda k: F.concat(F.lit('<w:style w:type="paragraph" w:styleId="s'), k.cast("string"), F.lit('">'), base(k), F.lit("<w:rPr>"), own(k), F.lit("</w:rPr></w:style>"))
    body = F.concat(F.lit('<w:docDefaults><w:rPrDefault><w:rPr><w:color w:val="00FF00"/></w:rPr></w:rPrDefault></w:docDefaults>'), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), style), ""))
    return P.once_per_content(_packages(rows, body), lambda parts: S.resolved_styles(*S.read_styles(parts)))


_FONTS = '<w:rFonts w:ascii="Arial" w:hAnsi="Arial" w:eastAsia="Arial" w:cs="Arial"/>'
_UPRIGHT = '<w:i w:val="0"/><w:iCs w:val="0"/>'
_LOOK = '<w:b/><w:bCs/><w:sz w:val="28"/><w:szCs w:val="28"/>'
_NORMAL = f'<w:style w:type="paragraph" w:styleId="Normal"><w:rPr>{_FONTS}<w:sz w:val="22"/><w:szCs w:val="22"/></w:rPr></w:style>'
_DEFAULT = '<w:style w:type="character" w:styleId="DefaultParagraphFont"/>'


def _heading(k: int, fonts: str = _FONTS, slant: str = _UPRIGHT, look: str = _LOOK, mark: str = _FONTS + _UPRIGHT + _LOOK) -> str:
    paragraph = f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:basedOn w:val="Normal"/><w:link w:val="Heading{k}Char"/><w:rPr>{fonts}{slant}{look}</w:rPr></w:style>'
    return paragraph + f'<w:style w:type="character" w:styleId="Heading{k}Char"><w:basedOn w:val="DefaultParagraphFont"/><w:link w:val="Heading{k}"/><w:rPr>{mark}</w:rPr></w:style>'


_REST = "".join(map(_heading, (2, 3, 4)))
#: Style sheets, and what is said of them.
SHEETS = [
    (_DEFAULT + _NORMAL + _heading(1) + _REST, []),
    (_DEFAULT + _NORMAL + _heading(1, fonts="", slant="") + _REST, [("Heading1", "explicitFonts", "equivalent"), ("Heading1", "italic", "equivalent")]),
    (_NORMAL + _heading(1, slant="") + _REST, [("Heading1", "italic", "drift"), ("Heading1", "linkedCharacterAgreement", "drift")]),
    ("<w:docDefaults><w:rPrDefault><w:rPr><w:i/></w:rPr></w:rPrDefault></w:docDefaults>" + _DEFAULT + _NORMAL + _heading(1, slant="") + _REST, [("Heading1", "italic", "drift"), ("Heading1", "linkedCharacterAgreement", "drift")]),
    (_DEFAULT + _NORMAL + _heading(1, look=_LOOK.replace('szCs w:val="28"', 'szCs w:val="30"')) + _REST, [("Heading1", "sizeHalfPoints", "drift"), ("Heading1", "linkedCharacterAgreement", "drift")]),
    (_DEFAULT + _NORMAL.replace('w:cs="Arial"', 'w:cs="Other"') + _heading(1) + _REST, [("Normal", "explicitFonts", "drift")]),
    (_DEFAULT + _NORMAL + _REST, [("Heading1", "presence", "drift"), ("Heading1Char", "presence", "drift")]),
    (_DEFAULT + _NORMAL + _heading(1).replace('<w:link w:val="Heading1"/>', "") + _REST, [("Heading1Char", "link", "drift")]),
    (_DEFAULT + _NORMAL + _heading(1, fonts=_FONTS.replace("Arial", "Times"), mark=_FONTS.replace("Arial", "Times") + _UPRIGHT + _LOOK) + _REST, [("Heading1", "explicitFonts", "drift"), ("Heading1Char", "explicitFonts", "drift")]),
]
_SAID = ", ".join(f"({v}, '{s}', '{p}', '{w}')" for v, (_, rows) in enumerate(SHEETS) for s, p, w in rows)


@query("r13_style_drift", f"SELECT 'p' || c_custkey AS package, style, property, verdict FROM customer JOIN (VALUES {_SAID}) e(v, style, property, verdict) ON c_custkey % {len(SHEETS)} = v")
def drift(spark, sf):
    """A style sheet a customer: exact, omitting with proof, omitting without it, or saying something else."""
    sheets = spark.createDataFrame([(v, body) for v, (body, _) in enumerate(SHEETS)], "v int, body string")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("package"), (F.col("c_custkey") % len(SHEETS)).cast("int").alias("v")).join(sheets, "v")
    return P.once_per_content(_packages(rows, F.col("body")), lambda parts: S.style_drift(*S.read_styles(parts)))
