"""Sources, markup scans, Markdown, styles, fit, edits, rasters and reconciliation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import edits as E
from docloom.operators import markdown as M
from docloom.operators import raster as R
from docloom.operators import reconcile as C
from docloom.operators import styles as Y
from docloom.plans.registry import query, table
from docloom.plans.relations import NODES_SQL, SNAPSHOT_SQL, order_snapshots, tree_nodes
from docloom.sources import documents as D
from docloom.sources import markup as K


@query("s5_materialise", r"SELECT doc_id, strlen(text) AS byte_len, sha256(text) AS sha256, length(text) AS char_len, length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS utf16_len, CASE WHEN strlen(text) > 4096 THEN 'SOURCE-TOO-LARGE' END AS diagnostic FROM documents")
def s5(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return D.materialise(files, max_bytes=4096).select("doc_id", "byte_len", "sha256", "char_len", "utf16_len", "diagnostic")


@query("s7_sniff_kind", "SELECT page_id, CASE WHEN regexp_matches(lower(h), '^(<!doctype html|<html)') THEN 'html' WHEN regexp_matches(lower(h), '^<svg[ >]') THEN 'svg' WHEN starts_with(h, '{') THEN 'manifest' ELSE 'unknown' END AS kind FROM (SELECT page_id, ltrim(CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<!-- c -->' || html ELSE '{\"a\": 1}' END) AS h0, regexp_replace(h0, '^<!-- c -->', '') AS h FROM pages)")
def s7(spark, sf):
    given = F.expr("CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<!-- c -->' || html ELSE '{\"a\": 1}' END")
    return table(spark, sf, "pages").select("page_id", given.alias("h")).select("page_id", D.sniff_kind("h").alias("kind"))


TAGS_SQL = r"tags AS (SELECT page_id, lower(regexp_extract(tag, '^([A-Za-z][A-Za-z0-9:-]*)', 1)) AS element, regexp_replace(tag, '^[A-Za-z][A-Za-z0-9:-]*', '') AS attributes FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][^<>]*)>', 1)) AS tag FROM pages))"
ATTR_SQL = r"""attrs AS (SELECT page_id, element, lower(regexp_extract(a, '^([^\s=]+)', 1)) AS name, regexp_extract(a, '"([^"]*)"$', 1) AS value FROM (SELECT page_id, element, unnest(regexp_extract_all(attributes, '([A-Za-z_:][A-Za-z0-9_:.-]*\s*=\s*"[^"]*")', 1)) AS a FROM tags))"""


@query("s8_s13_element_inventory", f"WITH {TAGS_SQL} SELECT page_id, element, count(*) AS n FROM tags GROUP BY ALL")
def s13(spark, sf):
    return D.tags(table(spark, sf, "pages")).groupBy("page_id", "element").agg(F.count("*").alias("n"))


@query("f6_f7_f8_security_findings", f"WITH {TAGS_SQL}, {ATTR_SQL}, hits AS (SELECT page_id, 'FORBIDDEN-ELEMENT' AS code FROM tags WHERE element IN ('script', 'iframe', 'object', 'embed', 'form', 'foreignobject', 'audio', 'video') UNION ALL SELECT page_id, CASE WHEN starts_with(name, 'on') THEN 'EVENT-HANDLER' WHEN name IN ('href', 'src', 'xlink:href', 'srcset', 'action', 'xml:base') AND NOT starts_with(value, '#') THEN 'UNSAFE-URL' WHEN name = 'style' AND regexp_matches(lower(value), '@import|url *[(]|image-set') THEN 'UNSAFE-CSS' END FROM attrs) SELECT page_id, code, count(*) AS n FROM hits WHERE code IS NOT NULL GROUP BY ALL")
def f6(spark, sf):
    return D.security_findings(table(spark, sf, "pages"))


@query("f13_attribute_allow_list", f"WITH {TAGS_SQL}, {ATTR_SQL} SELECT page_id, element, name, count(*) AS n FROM attrs WHERE name NOT IN ('class', 'href', 'src') GROUP BY ALL")
def f13(spark, sf):
    return D.attributes(D.tags(table(spark, sf, "pages"))).where(~F.col("name").isin("class", "href", "src")).groupBy("page_id", "element", "name").agg(F.count("*").alias("n"))


@query("f9_structure_limits", f"WITH {NODES_SQL} SELECT scope_id, count(*) AS n_elements, max(depth) AS depth FROM nodes GROUP BY ALL HAVING count(*) > 3300")
def f9(spark, sf):
    return D.structure_limits(tree_nodes(spark, sf), "scope_id", max_elements=3300)


@query("w10_line_starts", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line::INT AS line, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM l")
def w10(spark, sf):
    return D.line_starts(table(spark, sf, "documents"), "doc_id", "text")


MD_SQL = r"""md0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
md AS (SELECT doc_id, line, CASE (line - 1) % 9 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '1. ' WHEN 3 THEN '> ' WHEN 4 THEN '> ' ELSE '' END || t AS raw FROM md0),
kinds AS (SELECT doc_id, line, trim(raw) AS bare, CASE WHEN trim(raw) = '' THEN 'blank' WHEN regexp_matches(trim(raw), '^[|]') THEN 'table' WHEN starts_with(trim(raw), '>') THEN 'blockquote' WHEN regexp_matches(trim(raw), '^#{1,4}\s') THEN 'heading' WHEN regexp_matches(trim(raw), '^[-*]\s') THEN 'bullet' WHEN regexp_matches(trim(raw), '^[0-9]+[.]\s') THEN 'numbered' ELSE 'paragraph' END AS kind FROM md),
runs AS (SELECT *, sum(CASE WHEN kind IN ('heading', 'bullet', 'numbered') OR kind IS DISTINCT FROM lag THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS lag FROM kinds)),
blocks AS (SELECT doc_id, run, min(kind) AS kind, min(line)::INT AS line, string_agg(CASE kind WHEN 'heading' THEN regexp_replace(bare, '^#+\s+', '') WHEN 'bullet' THEN regexp_replace(bare, '^[-*]\s+', '') WHEN 'blockquote' THEN trim(substr(bare, 2)) ELSE bare END, ' ' ORDER BY line) AS value FROM runs WHERE kind <> 'blank' GROUP BY doc_id, run)"""


def _markdown(spark, sf):
    """Documents with their lines dressed as headings, list items and quotes by their number."""
    dressed = F.transform(F.split("text", "\n", -1), lambda t, i: F.concat(F.element_at(F.array(*[F.lit(x) for x in ("# ", "- ", "1. ", "> ", "> ", "", "", "", "")]), (i % 9 + 1).cast("int")), t))
    return table(spark, sf, "documents").select("doc_id", F.array_join(dressed, "\n").alias("text"))


@query("s19_markdown_blocks", f"WITH {MD_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::INT AS ordinal, kind, CASE WHEN kind = 'heading' THEN 1 END AS level, value, line FROM blocks")
def s19(spark, sf):
    return M.blocks(_markdown(spark, sf))


@query("k5_canonical_markdown", f"WITH {MD_SQL} SELECT doc_id, rtrim(string_agg(CASE kind WHEN 'heading' THEN '# ' || value WHEN 'bullet' THEN '- ' || value WHEN 'blockquote' THEN '> ' || value ELSE value END, chr(10) || chr(10) ORDER BY run)) || chr(10) AS markdown FROM blocks GROUP BY doc_id")
def k5(spark, sf):
    return M.canonical(_markdown(spark, sf))


@query("f15_markdown_refusals", r"SELECT doc_id, line::INT AS line, code FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line, 'HARD-BREAK' AS code FROM (SELECT doc_id, replace(text, '.' || chr(10), '.  ' || chr(10)) AS text FROM documents)) WHERE trim(raw) <> '' AND regexp_matches(raw, '(  |\\)$')")
def f15(spark, sf):
    return M.refusals(table(spark, sf, "documents").select("doc_id", F.expr("replace(text, '.\\n', '.  \\n')").alias("text"))).where("code = 'HARD-BREAK'")


@query("c2_demote_links", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'see ' || source || ' (http://h/' || doc_id || ') now' WHEN 1 THEN 'see http://h/' || doc_id || ' now' ELSE 'see ' || source || ' now' END AS value FROM documents")
def c2(spark, sf):
    link = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('see [', source, '](http://h/', doc_id, ') now') WHEN 1 THEN concat('see [http://h/', doc_id, '](http://h/', doc_id, ') now') ELSE concat('see [', source, '](local.md) now') END")
    return table(spark, sf, "documents").select("doc_id", S.demote_links(link).alias("value"))


@query("c5_table_cells", r"SELECT doc_id, list_transform(string_split(lang || ' | ' || source || ' | ' || n_chars, '|'), lambda c: trim(c)) AS cells FROM documents")
def c5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.table_cells(F.expr("concat('| ', lang, ' | ', source, ' | ', n_chars, ' |')")).alias("cells"))


@query("c9_escape", "SELECT page_id, replace(replace(replace(replace(url || '?a&b<c>\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS value FROM pages")
def c9(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.escape_xml(F.concat("url", F.lit('?a&b<c>"')), attribute=True).alias("value"))


@query("c24_c31_hash_ids", "SELECT p_partkey, 'finding.' || left(sha256(p_name), 16) AS finding_id, to_base64(encode(p_name)) AS encoded FROM part")
def c24(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.short_hash_id("finding", "p_name").alias("finding_id"), F.base64(F.encode("p_name", "UTF-8")).alias("encoded"))


@query("c25_fnv1a_ids", "SELECT p_partkey, h, 2 + h % 2147483646 AS object_id, 256 + h % 2147483392 AS slide_id FROM (SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(strlen(p_name)), lambda i: ('0x' || substr(hex(encode(p_name)), (2 * i + 1)::INT, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM part)")
def c25(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.fnv1a32("p_name").alias("h"), S.numeric_id("p_name").alias("object_id"), S.numeric_id("p_name", 256).alias("slide_id"))


@query("c10_c14_values", r"SELECT p_partkey, try_cast(CASE WHEN regexp_full_match(s, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN s END AS DOUBLE) AS number, CASE WHEN regexp_full_match(c, '#[0-9A-Fa-f]{6}') THEN lower(c) END AS colour FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '-' || p_size || '.50' WHEN 2 THEN p_size || 'px' ELSE '.5e1' END AS s, CASE p_partkey % 3 WHEN 0 THEN '#AbC0' || (10 + p_size % 90) ELSE 'red' END AS c FROM part)")
def c10(spark, sf):
    s = F.expr("CASE p_partkey % 4 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN concat('-', p_size, '.50') WHEN 2 THEN concat(p_size, 'px') ELSE '.5e1' END")
    c = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('#AbC0', 10 + p_size % 90) ELSE 'red' END")
    return table(spark, sf, "part").select("p_partkey", S.strict_number(s).alias("number"), S.hex_colour(c).alias("colour"))


@query("c11_style_values", r"""WITH v AS (SELECT p_partkey, ['fill', 'stroke', 'stroke-width', 'font-size', 'opacity', 'font-family', 'font-weight', 'font-style', 'text-anchor', 'margin'][p_partkey % 10 + 1] AS property,
  trim([' None ', '#AbCdEf', p_size || 'px', '0', '0.5', p_brand, '"' || p_brand || '"', '700', 'Italic', 'MIDDLE', 'var(--x)', 'serif', '#abc', '-1', 'inherit', '1 !important', ''][p_partkey % 17 + 1]) AS e FROM part),
n AS (SELECT *, lower(e) AS low, try_cast(regexp_extract(lower(e), '^([+-]?[0-9.]+)(px)?$', 1) AS DOUBLE) AS num, e = '' OR e = 'inherit' OR e LIKE 'var(%' OR e LIKE '%!important' AS banned FROM v),
r AS (SELECT *, CASE WHEN banned THEN NULL WHEN property IN ('fill', 'stroke') AND regexp_full_match(low, 'none|#[0-9a-f]{6}') THEN low WHEN property = 'font-style' AND low IN ('normal', 'italic') THEN low WHEN property = 'text-anchor' AND low IN ('start', 'middle', 'end') THEN low
    WHEN property = 'font-family' AND e LIKE '"%' THEN e[2:-2] WHEN property = 'font-family' AND low <> 'serif' AND regexp_full_match(e, '[A-Za-z]+') THEN e END AS text,
  CASE WHEN banned THEN NULL WHEN property = 'stroke-width' AND num >= 0 THEN num WHEN property = 'font-size' AND num > 0 THEN num WHEN property = 'opacity' AND low NOT LIKE '%px' AND num BETWEEN 0 AND 1 THEN num WHEN property = 'font-weight' AND e IN ('400', '700') THEN num END AS number FROM n)
SELECT p_partkey, property, text, number, CASE WHEN property = 'margin' THEN 'UNKNOWN' WHEN text IS NOT NULL OR number IS NOT NULL THEN NULL WHEN NOT banned AND property IN ('font-family', 'font-weight', 'font-style') THEN 'FONT' ELSE 'VALUE' END AS code FROM r""")
def c11(spark, sf):
    properties = "element_at(array('fill', 'stroke', 'stroke-width', 'font-size', 'opacity', 'font-family', 'font-weight', 'font-style', 'text-anchor', 'margin'), cast(p_partkey % 10 + 1 AS int)) AS property"
    given = """element_at(array(' None ', '#AbCdEf', concat(p_size, 'px'), '0', '0.5', p_brand, concat('"', p_brand, '"'), '700', 'Italic', 'MIDDLE', 'var(--x)', 'serif', '#abc', '-1', 'inherit', '1 !important', ''), cast(p_partkey % 17 + 1 AS int)) AS given"""
    found = table(spark, sf, "part").selectExpr("p_partkey", properties, given).withColumn("v", Y.style_value("property", "given"))
    return found.select("p_partkey", "property", "v.text", "v.number", "v.code")


@query("s10_strict_xml", "SELECT doc_id, ['XML-MALFORMED', 'XML-DOCTYPE', 'XML-NAMESPACE', 'XML-VERSION'][doc_id % 7] AS code, 'fatal' AS severity FROM documents WHERE doc_id % 7 BETWEEN 1 AND 4")
def s10(spark, sf):
    """Each text as a diagram, some of them spoilt; characters that XML cannot hold are taken out first."""
    body = S.escape_xml(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))
    whole = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><text>'), body, F.lit("</text></svg>"))
    spoilt = [F.concat(whole, F.lit("<g/>")), F.concat(F.lit("<!DOCTYPE svg>"), whole), F.concat(F.lit("<x:svg>"), body, F.lit("</x:svg>")), F.concat(F.lit('<?xml version="1.1"?>'), whole), F.concat(F.lit('<?xml version="1.0"?>'), whole)]
    text = whole
    for k, other in enumerate(spoilt, 1):
        text = F.when(F.col("doc_id") % 7 == k, other).otherwise(text)
    return K.xml_findings(table(spark, sf, "documents").select("doc_id", text.alias("text")))


@query("c17_c18_emu_round_trip", "SELECT p_partkey, CASE WHEN u * 7620 = floor(u * 7620) THEN (u * 7620)::BIGINT END AS emu, CASE WHEN u * 7620 = floor(u * 7620) THEN (u * 7620)::BIGINT / 7620.0::DOUBLE END AS back FROM (SELECT p_partkey, p_size / CASE WHEN p_partkey % 2 = 0 THEN 4.0::DOUBLE ELSE 7.0::DOUBLE END AS u FROM part)")
def c17(spark, sf):
    u = F.expr("p_size / CASE WHEN p_partkey % 2 = 0 THEN 4.0D ELSE 7.0D END")
    return table(spark, sf, "part").select("p_partkey", S.to_emu(u).alias("emu")).withColumn("back", S.from_emu("emu"))


@query("w1_exact_baseline_steps", "SELECT doc_id, k, CAST(y AS DECIMAL(20,1)) - CAST(p AS DECIMAL(20,1)) = 0.2 AS exact FROM (SELECT doc_id, k, y, lag(y) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM (SELECT doc_id, k, ((2 * k + 1 + CASE WHEN doc_id % 5 = 0 AND k = 2 THEN 1 ELSE 0 END)::DECIMAL(20,1) / 10)::DECIMAL(20,1) AS y FROM documents, range(4) g(k))) WHERE p IS NOT NULL")
def w1(spark, sf):
    """Decimals: .1 + .2 = .3 must hold."""
    from pyspark.sql import Window

    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    y = (F.expr("2 * k + 1 + CASE WHEN doc_id % 5 = 0 AND k = 2 THEN 1 ELSE 0 END").cast("decimal(20,1)") / F.lit(10)).cast("decimal(20,1)")
    before = F.lag("y").over(Window.partitionBy("doc_id").orderBy("k"))
    return rows.withColumn("y", y).withColumn("p", before).where("p IS NOT NULL").select("doc_id", "k", ((F.col("y") - F.col("p")) == F.lit("0.2").cast("decimal(20,1)")).alias("exact"))


FIT_SQL = """fit AS (SELECT doc_id, k, CASE k % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE 'middle' END AS anchor, (100 + k % 5 * 50)::DOUBLE AS anchor_x, CASE WHEN length(raw) = 0 THEN NULL ELSE length(raw) * 1.5::DOUBLE END AS width
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
room AS (SELECT *, CASE anchor WHEN 'start' THEN 600 - anchor_x WHEN 'end' THEN anchor_x - 100 ELSE 2 * least(anchor_x - 100, 600 - anchor_x) END AS available FROM fit),
fitted AS (SELECT *, CASE WHEN width IS NULL THEN 'unverified' WHEN width > available THEN 'overflow' WHEN width / nullif(available, 0) >= 0.9 THEN 'near-limit' ELSE 'clear' END AS status FROM room)"""


def _fitted(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "raw")).withColumn("k", F.col("k") + 1)
    placed = lines.withColumn("anchor", F.element_at(F.array(F.lit("start"), F.lit("end"), F.lit("middle")), F.col("k") % 3 + 1)).withColumn("anchor_x", (F.col("k") % 5 * 50 + 100).cast("double"))
    placed = placed.withColumn("frame_x", F.lit(100.0)).withColumn("frame_width", F.lit(500.0))
    return Y.fit_lines(placed, F.when(F.length("raw") > 0, F.length("raw") * F.lit(1.5)))


@query("c20_c21_text_fit", f"WITH {FIT_SQL} SELECT doc_id, k::INT AS k, width, available, status FROM fitted")
def c20(spark, sf):
    return _fitted(spark, sf).select("doc_id", "k", "width", "available", "status")


@query("a2_text_fit_summary", f"WITH {FIT_SQL} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'clear') AS n_clear, count(*) FILTER (status = 'near-limit') AS n_near_limit, count(*) FILTER (status = 'overflow') AS n_overflow, count(*) FILTER (status = 'unverified') AS n_unverified FROM fitted GROUP BY doc_id")
def a2(spark, sf):
    return Y.fit_summary(_fitted(spark, sf), "doc_id")


@query("a18_a19_calibration", "SELECT label, max(abs(a - b)) AS max_absolute, max(abs(a - b) / nullif(abs(b), 0)) AS max_relative, bool_and(abs(a - b) <= 0.75 OR coalesce(abs(a - b) / nullif(abs(b), 0) <= 0.01, false)) AS all_within, sum(abs(floor(a + 0.5) - a)) AS envelope FROM (SELECT label, vec_id * 1.5::DOUBLE + (vec_id % 8) * 0.125::DOUBLE AS a, vec_id * 1.5::DOUBLE AS b FROM embeddings) GROUP BY label")
def a18(spark, sf):
    """Widths that are up to 0.875 units wider than the oracle's."""
    samples = table(spark, sf, "embeddings").select("label", F.expr("vec_id * 1.5D + vec_id % 8 * 0.125D").alias("a"), F.expr("vec_id * 1.5D").alias("b"))
    return Y.calibration(samples, "label", "a", "b")


@query("j16_a19_glyph_widths", "SELECT p_partkey, count(*) FILTER (g.advance IS NULL) AS n_missing, coalesce(sum(g.advance), 0)::BIGINT AS width FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part) c LEFT JOIN (SELECT DISTINCT substr(p_brand, i, 1) AS ch, 5 + unicode(substr(p_brand, i, 1)) % 7 AS advance FROM part, range(1, 20) t(i) WHERE i <= length(p_brand)) g USING (ch) GROUP BY p_partkey")
def j16(spark, sf):
    """Text widths from a table of glyph advances; code points without a glyph are counted."""
    part = table(spark, sf, "part")
    glyphs = part.select(F.explode(F.split("p_brand", "")).alias("ch")).where("ch <> ''").distinct().withColumn("advance", 5 + F.ascii("ch") % 7)
    chars = part.select("p_partkey", F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''")
    return chars.join(glyphs, "ch", "left").groupBy("p_partkey").agg(F.count_if(F.col("advance").isNull()).alias("n_missing"), F.coalesce(F.sum("advance"), F.lit(0)).cast("long").alias("width"))


RULES = [("Brand#11", 0, "fill", "#112233", None), ("Brand#11", 1, "stroke", None, "accent"), ("size-1", 2, "fill", None, "surface"), ("size-2", 3, "stroke-width", "4", None), ("size-0", 4, "opacity", "0.5", None), ("Brand#23", 5, "fill", "#abcdef", None), ("size-1", 6, "stroke", "#000001", None)]
THEME = [("accent", "#6f5cff"), ("surface", "#f2f5f4")]
_RULES_SQL = ", ".join(f"('{c}', {o}, '{p}', {'NULL' if l is None else repr(l)}, {'NULL' if t is None else repr(t)})" for c, o, p, l, t in RULES)
CASCADE_SQL = f"""rules(class, source_order, property, literal, token) AS (VALUES {_RULES_SQL}), theme(token, expression) AS (VALUES ('accent', '#6f5cff'), ('surface', '#f2f5f4')),
n AS (SELECT p_partkey AS id, p_brand, 'size-' || p_size % 3 AS size_class, p_partkey % 5 AS a, p_partkey % 7 AS i FROM part),
given AS (SELECT n.id, r.property, 2 AS origin, r.source_order, coalesce(r.literal, t.expression) AS value FROM n JOIN rules r ON r.class = n.p_brand OR r.class = n.size_class LEFT JOIN theme t USING (token)
  UNION ALL SELECT id, 'fill', 1, 0, '#aaaaaa' FROM n WHERE a = 0 UNION ALL SELECT id, 'stroke-width', 1, 0, '2' FROM n WHERE a = 0 UNION ALL SELECT id, 'opacity', 3, 0, '0.9' FROM n WHERE i = 3
  UNION ALL SELECT id, p, 0, 0, v FROM n, (VALUES ('fill', '#000000'), ('stroke', 'none'), ('stroke-width', '1'), ('opacity', '1'), ('font-weight', '400'), ('font-style', 'normal'), ('text-anchor', 'start')) d(p, v)),
best AS (SELECT *, row_number() OVER (PARTITION BY id, property ORDER BY origin DESC, source_order DESC) AS k FROM given)"""


def _styled(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "array(p_brand, concat('size-', p_size % 3)) AS classes",
        "CASE WHEN p_partkey % 5 = 0 THEN map('fill', '#aaaaaa', 'stroke-width', '2') ELSE cast(map() AS map<string,string>) END AS attributes", "CASE WHEN p_partkey % 7 = 3 THEN map('opacity', '0.9') ELSE cast(map() AS map<string,string>) END AS inline",
    )


def _cascaded(spark, sf):
    rules = spark.createDataFrame(RULES, "class string, source_order int, property string, literal string, token string")
    return Y.cascade(_styled(spark, sf), rules, spark.createDataFrame(THEME, "token string, expression string"))


@query("w13_j10_j11_style_cascade", f"WITH {CASCADE_SQL} SELECT id, property, value, CASE origin WHEN 3 THEN 'inline-style' WHEN 2 THEN 'base-rule' WHEN 1 THEN 'presentation-attribute' ELSE 'default' END AS origin FROM best WHERE k = 1")
def w13(spark, sf):
    return _cascaded(spark, sf)


@query("c35_style_text", f"WITH {CASCADE_SQL} SELECT id, string_agg(property || ':' || value, ';' ORDER BY property || ':' || value) AS style FROM best WHERE k = 1 GROUP BY id")
def c35(spark, sf):
    return Y.style_text(_cascaded(spark, sf))


@query("j12_theme_parity", "WITH t AS (SELECT DISTINCT p_brand AS theme_id, 'size-' || p_size AS token FROM part), e AS (SELECT DISTINCT token FROM t), b AS (SELECT DISTINCT theme_id FROM t) SELECT b.theme_id, e.token FROM b, e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.theme_id = b.theme_id AND t.token = e.token)")
def j12(spark, sf):
    return Y.theme_parity(table(spark, sf, "part").selectExpr("p_brand AS theme_id", "concat('size-', p_size) AS token").distinct())


@query("w14_world_offsets", f"WITH {NODES_SQL}, t AS (SELECT id, ancestor_ids, (sibling_order % 50)::DOUBLE AS tx, (sibling_order % 7)::DOUBLE AS ty FROM nodes), u AS (SELECT t.id, a.tx, a.ty FROM (SELECT id, unnest(ancestor_ids) AS a FROM t) t JOIN t a ON a.id = t.a UNION ALL SELECT id, tx, ty FROM t) SELECT id, sum(tx) AS world_x, sum(ty) AS world_y FROM u GROUP BY id")
def w14(spark, sf):
    return Y.world_offsets(tree_nodes(spark, sf).selectExpr("id", "ancestor_ids", "cast(sibling_order % 50 AS double) AS tx", "cast(sibling_order % 7 AS double) AS ty"))


@query("a7_a8_group_bounds", f"WITH {NODES_SQL}, leaf AS (SELECT unnest(ancestor_ids) AS id, sibling_order % 997 AS x, sibling_order % 613 AS y, sibling_order % 997 + sibling_order % 31 AS r, sibling_order % 613 + sibling_order % 17 AS b FROM nodes WHERE depth = 3) SELECT id, min(x) AS x, min(y) AS y, max(r) - min(x) AS width, max(b) - min(y) AS height FROM leaf GROUP BY id")
def a8(spark, sf):
    leaves = tree_nodes(spark, sf).where("depth = 3").selectExpr("ancestor_ids", "sibling_order % 997 AS x", "sibling_order % 613 AS y", "sibling_order % 31 AS width", "sibling_order % 17 AS height")
    return Y.group_bounds(leaves)


@query("a9_palette_hash", "SELECT p_brand, sha256('[' || string_agg(DISTINCT p_type || '|' || p_size, ',' ORDER BY p_type || '|' || p_size) || ']') AS palette_sha256 FROM part GROUP BY p_brand")
def a9(spark, sf):
    return Y.palette_hash(table(spark, sf, "part"), "p_brand", "p_type", "p_size")


OPS_SQL = """ops AS (SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 5 THEN 'set-unknown' WHEN 4 THEN 'set-native-style' ELSE 'set-text' END AS op, CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS id,
  CASE WHEN o_orderkey % 6 = 4 THEN o_orderstatus WHEN o_orderkey % 11 = 0 THEN 'old' ELSE o_orderpriority END AS old, 'new' AS new FROM orders WHERE o_orderkey % 10 < 3 UNION ALL SELECT o_orderkey + 10000000, 'set-text', o_orderkey, o_orderpriority, 'x' FROM orders WHERE o_orderkey % 50 = 0)"""


def _ops(spark, sf):
    orders = table(spark, sf, "orders")
    one = orders.where("o_orderkey % 10 < 3").selectExpr(
        "o_orderkey AS seq", "CASE o_orderkey % 6 WHEN 5 THEN 'set-unknown' WHEN 4 THEN 'set-native-style' ELSE 'set-text' END AS op", "CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS id",
        "CASE WHEN o_orderkey % 6 = 4 THEN o_orderstatus WHEN o_orderkey % 11 = 0 THEN 'old' ELSE o_orderpriority END AS old", "'new' AS new",
    )
    return one.unionByName(orders.where("o_orderkey % 50 = 0").selectExpr("o_orderkey + 10000000 AS seq", "'set-text' AS op", "o_orderkey AS id", "o_orderpriority AS old", "'x' AS new"))


@query("m1_m11_m12_m13_check_operations", f"WITH {OPS_SQL} SELECT p.*, CASE WHEN op = 'set-unknown' THEN 'unsupported' WHEN o.o_orderkey IS NULL THEN 'unknown-target' WHEN (SELECT count(*) FROM ops q WHERE q.id = p.id AND q.op = p.op) > 1 THEN 'conflicting' WHEN old IS DISTINCT FROM CASE op WHEN 'set-text' THEN o.o_orderpriority ELSE o.o_orderstatus END THEN 'stale-value' ELSE 'ok' END AS verdict FROM ops p LEFT JOIN orders o ON o.o_orderkey = p.id")
def m1(spark, sf):
    return E.check_operations(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS text", "o_orderstatus AS style"), _ops(spark, sf))


@query("m1_apply_operations", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN 'new' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 10 = 2 THEN 'Z' ELSE o_orderstatus END AS style FROM orders")
def m1_apply(spark, sf):
    orders = table(spark, sf, "orders")
    ops = orders.where("o_orderkey % 10 IN (1, 2)").selectExpr("o_orderkey AS seq", "CASE o_orderkey % 10 WHEN 1 THEN 'set-text' ELSE 'set-native-style' END AS op", "o_orderkey AS id", "CASE o_orderkey % 10 WHEN 1 THEN o_orderpriority ELSE o_orderstatus END AS old", "CASE o_orderkey % 10 WHEN 1 THEN 'new' ELSE 'Z' END AS new")
    return E.apply_operations(orders.selectExpr("o_orderkey AS id", "o_orderpriority AS text", "o_orderstatus AS style"), ops)[0]


@query("m3_m9_x3_order_permutation", "SELECT l_orderkey, list_sort(a) = list_sort(b) AS permutation FROM (SELECT l_orderkey, list(l_linenumber) AS a, list(CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 1 THEN 9 ELSE l_linenumber END) AS b FROM lineitem GROUP BY l_orderkey)")
def m3(spark, sf):
    both = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"), F.collect_list(F.expr("CASE WHEN l_orderkey % 4 = 0 AND l_linenumber = 1 THEN 9 ELSE l_linenumber END")).alias("b"))
    return both.select("l_orderkey", E.is_permutation(F.col("a"), F.col("b")).alias("permutation"))


@query("m10_delete_subtrees", f"WITH {NODES_SQL} SELECT id FROM nodes WHERE NOT (id LIKE 'c.%' AND sibling_order % 10 = 0) AND NOT list_has_any(ancestor_ids, (SELECT list(id) FROM nodes WHERE id LIKE 'c.%' AND sibling_order % 10 = 0)) AND id <> 'n.5' AND NOT list_contains(ancestor_ids, 'n.5')")
def m10(spark, sf):
    nodes = tree_nodes(spark, sf)
    return E.delete_subtrees(nodes, nodes.where("(depth = 2 AND sibling_order % 10 = 0) OR id = 'n.5'")).select("id")


@query("m14_o4_splice", "SELECT doc_id, 'X' || substr(text, 4, 6) || 'YY' || substr(text, 13) AS value FROM documents")
def m14(spark, sf):
    """A text shorter than an edit's place gets the replacement at its end."""
    edit = lambda a, b, r: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement"))
    return table(spark, sf, "documents").select("doc_id", S.splice("text", F.array(edit(0, 3, "X"), edit(9, 12, "YY"))).alias("value"))


PIXELS_SQL = """p AS (SELECT vec_id AS img, generate_subscripts(embedding, 1) AS pos, floor(abs(unnest(embedding))::DOUBLE * 1000)::BIGINT % 256 AS r FROM embeddings),
j AS (SELECT coalesce(a.img, b.img - 1) AS img, (coalesce(a.pos, b.pos) - 1) % 8 AS x, (coalesce(a.pos, b.pos) - 1) // 8 AS y, coalesce(abs(a.r - b.r), 255) AS delta, a.r IS NULL OR b.r IS NULL AS alone, a.img IS NOT NULL AND (a.pos - 1) % 11 = 3 AS ignored FROM p a FULL JOIN p b ON b.img = a.img + 1 AND b.pos = a.pos)"""


def _pixels(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("img", (F.col("pos") % 8).cast("long").alias("x"), F.expr("pos div 8").alias("y"), (F.floor(F.abs(F.col("v").cast("double")) * 1000) % 256).alias("r"), "pos")


@query("a15_a16_image_diff", f"WITH {PIXELS_SQL} SELECT img, count(*) AS pixels, count(*) FILTER (alone) AS unmatched, count(*) FILTER (ignored) AS masked, count(*) FILTER (NOT ignored AND delta > 40) AS changed, (sum(delta) FILTER (NOT ignored))::BIGINT AS absolute, max(delta) FILTER (NOT ignored) AS max_delta, min(x) FILTER (NOT ignored AND delta > 40) AS x0, min(y) FILTER (NOT ignored AND delta > 40) AS y0, max(x) FILTER (NOT ignored AND delta > 40) AS x1, max(y) FILTER (NOT ignored AND delta > 40) AS y1 FROM j GROUP BY img")
def a15(spark, sf):
    p = _pixels(spark, sf)
    mask = p.select("img", "x", "y", F.when(F.col("pos") % 11 == 3, 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    after = p.withColumn("img", F.col("img") - 1)
    return R.image_diff(p, after, tolerance=40, mask=mask, channels=("r",)).select("img", "pixels", "unmatched", "masked", "changed", "absolute", "max_delta", "x0", "y0", "x1", "y1")


@query("a17_threshold_verdict", f"WITH {PIXELS_SQL} SELECT img, CASE WHEN bool_and(NOT alone) AND (count(*) FILTER (delta > 0))::DOUBLE / count(*) <= 0.99 AND sum(delta)::DOUBLE / count(*) <= 60 AND max(delta) <= 250 THEN 'passed' ELSE 'failed' END AS verdict FROM j GROUP BY img")
def a17(spark, sf):
    p = _pixels(spark, sf)
    return R.verdict(R.image_diff(p, p.withColumn("img", F.col("img") - 1), channels=("r",)), 0.99, 60, 250).select("img", "verdict")


OPERATIONS = {"text": "set-text", "geometry": "set-object-geometry", "style": "set-native-style"}


@query("j2_r3_candidate_operations", f"WITH {SNAPSHOT_SQL} SELECT l.id, op, old, new FROM lefts l JOIN rights r USING (id), LATERAL (VALUES ('set-text', l.text, r.text), ('set-object-geometry', l.geometry::VARCHAR, r.geometry::VARCHAR), ('set-native-style', l.style, r.style)) v(op, old, new) WHERE old IS DISTINCT FROM new")
def r3(spark, sf):
    return C.candidate_operations(*order_snapshots(spark, sf), OPERATIONS)


@query("r4_reordered_parents", "WITH a AS (SELECT o_custkey AS parent_id, o_orderkey AS id, o_orderdate AS k FROM orders), b AS (SELECT o_custkey AS parent_id, o_orderkey AS id, CASE WHEN o_custkey % 6 = 0 THEN -o_totalprice ELSE epoch(o_orderdate)::DOUBLE END AS k FROM orders) SELECT x.parent_id, x.o AS old, y.o AS new FROM (SELECT parent_id, list(id ORDER BY k, id) AS o FROM a GROUP BY ALL) x JOIN (SELECT parent_id, list(id ORDER BY k, id) AS o FROM b GROUP BY ALL) y USING (parent_id) WHERE x.o <> y.o")
def r4(spark, sf):
    orders = table(spark, sf, "orders")
    base = orders.selectExpr("o_custkey AS parent_id", "o_orderkey AS id", "o_orderdate AS sibling_order")
    edited = orders.selectExpr("o_custkey AS parent_id", "o_orderkey AS id", "CASE WHEN o_custkey % 6 = 0 THEN -o_totalprice ELSE cast(unix_timestamp(o_orderdate) AS double) END AS sibling_order")
    return C.reordered_parents(base, edited)


def _findings(spark, sf):
    ops = C.candidate_operations(*order_snapshots(spark, sf), OPERATIONS)
    disposition = F.when(F.col("op") == "set-native-style", "review").otherwise("auto-fixable")
    return C.findings(ops, disposition, F.when(F.col("new").isNull(), "normalisation").otherwise("source-change"))


@query("r8_o2_findings", f"WITH {SNAPSHOT_SQL}, o AS (SELECT l.id, op, old, new FROM lefts l JOIN rights r USING (id), LATERAL (VALUES ('set-text', l.text, r.text), ('set-object-geometry', l.geometry::VARCHAR, r.geometry::VARCHAR), ('set-native-style', l.style, r.style)) v(op, old, new) WHERE old IS DISTINCT FROM new) SELECT id, op, CASE WHEN op = 'set-native-style' THEN 'review' ELSE 'auto-fixable' END AS disposition, (CASE WHEN op = 'set-native-style' THEN 2 ELSE 1 END + CASE WHEN new IS NULL THEN 10 ELSE 20 END)::INT AS rank, 'finding.' || left(sha256(id || '|' || op || '|' || coalesce(old, '') || '|' || coalesce(new, '')), 16) AS finding_id FROM o")
def r8(spark, sf):
    return _findings(spark, sf).select("id", "op", "disposition", "rank", "finding_id")


@query("r9_a28_status", f"WITH {SNAPSHOT_SQL}, o AS (SELECT op, new FROM lefts l JOIN rights r USING (id), LATERAL (VALUES ('set-text', l.text, r.text), ('set-object-geometry', l.geometry::VARCHAR, r.geometry::VARCHAR), ('set-native-style', l.style, r.style)) v(op, old, new) WHERE old IS DISTINCT FROM new) SELECT count(*) FILTER (op <> 'set-native-style') AS n_auto_fixable, count(*) FILTER (op = 'set-native-style') AS n_review, 0::BIGINT AS n_refused, 0::BIGINT AS n_none, count(*) FILTER (new IS NULL) AS n_normalisation, count(*) FILTER (new IS NOT NULL) AS n_source_change, 'review' AS highest, 'review-required' AS status FROM o")
def r9(spark, sf):
    return C.status(_findings(spark, sf))


T6_SQL = """t AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 3 THEN 'undo' WHEN turn % 5 = 4 THEN 'redo' ELSE 'set' END AS action FROM conversations),
s AS (SELECT conv_id, list({'a': action, 'v': text} ORDER BY turn) AS log FROM t GROUP BY conv_id),
f AS (SELECT conv_id, 0 AS i, log, []::VARCHAR[] AS past, []::VARCHAR[] AS future FROM s
  UNION ALL SELECT conv_id, i + 1, log,
    CASE WHEN log[i + 1].a = 'set' THEN past || [log[i + 1].v] WHEN log[i + 1].a = 'undo' THEN past[:-2] WHEN len(future) > 0 THEN past || [future[-1]] ELSE past END,
    CASE WHEN log[i + 1].a = 'set' THEN [] WHEN log[i + 1].a = 'undo' AND len(past) > 0 THEN future || [past[-1]] WHEN log[i + 1].a = 'redo' THEN future[:-2] ELSE future END
  FROM f WHERE i < len(log))"""


@query("t6_session_fold", f"WITH RECURSIVE {T6_SQL} SELECT conv_id AS session, past[-1] AS value, len(past)::INT AS depth, len(future)::INT AS undone FROM f WHERE i = len(log)")
def t6(spark, sf):
    """Whole sessions with undo and redo."""
    action = "CASE WHEN turn % 5 = 3 THEN 'undo' WHEN turn % 5 = 4 THEN 'redo' ELSE 'set' END AS action"
    return E.fold_sessions(table(spark, sf, "conversations").selectExpr("conv_id AS session", "turn AS seq", action, "text AS value"))


@query("p15_redaction", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[redacted]' ELSE props END AS v FROM events")
def p15(spark, sf):
    """Values of private keys are masked by name."""
    pairs = F.create_map(F.when(F.col("event_id") % 2 == 0, "userPassword").otherwise("note"), F.col("props"))
    return table(spark, sf, "events").select("event_id", F.map_values(D.redact_private(pairs))[0].alias("v"))
