"""Parsing, limits, ordering and small joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import json_text as J
from docloom.functions import scalars as S
from docloom.operators import edits as E
from docloom.operators import integrity as I
from docloom.operators import model as M
from docloom.operators import objects as O
from docloom.operators import reconcile as C
from docloom.operators import repository as R
from docloom.operators import styles as Y
from docloom.plans.registry import query, table
from docloom.plans.relations import NODES_SQL, SNAPSHOT_SQL, order_snapshots, tree_nodes
from docloom.sources import documents as D
from docloom.sources import markup as K
from docloom.sources import packages as P
from docloom.sources.shared_tables import SharedTables


@query("s3_s14_parse_manifest", "SELECT event_id AS doc_id, event_type AS title, k.i::INT AS slide_order, CASE k.i WHEN 0 THEN 's' || user_id ELSE 't' || user_id END AS scope_id, k.i = 1 AS hidden FROM events, (VALUES (0), (1)) k(i)")
def s3(spark, sf):
    """Manifests of two slides: one named, one an object."""
    body = F.format_string('{"title": "%s", "slides": ["s%s", {"id": "t%s", "hidden": true}]}', "event_type", F.col("user_id").cast("string"), F.col("user_id").cast("string"))
    found = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.lit("manifest").alias("kind"), body.alias("body"))
    return K.manifests(found).select("doc_id", "title", "slide_order", "scope_id", "hidden")


@query("s27_d25_resolution_order", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END, 'built-in') AS template FROM documents")
def s27(spark, sf):
    explicit, local = F.when(F.col("doc_id") % 5 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", S.first_given(explicit, local, F.lit("built-in")).alias("template"))


@query("k8_provenance_stamp", "SELECT doc_id, right('source=' || source || ';sha256=' || left(sha256(text), 16), 255) AS stamp FROM documents")
def k8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.provenance_stamp("source", "text").alias("stamp"))


@query("k12_self_hash", "SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS evidence_sha256 FROM part")
def k12(spark, sf):
    body = F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return table(spark, sf, "part").select("p_partkey", J.self_hash(body).alias("evidence_sha256"))


@query("f10_role_element_matrix", f"WITH {NODES_SQL} SELECT id, role, element FROM (SELECT id, role, CASE WHEN sibling_order % 7 = 0 THEN 'circle' WHEN sibling_order % 7 = 1 THEN 'text' ELSE element END AS element FROM nodes) WHERE NOT ((role = 'shape' AND element IN ('rect', 'circle', 'ellipse')) OR (role = 'text' AND element = 'text') OR (role = 'connector' AND element IN ('line', 'polyline')) OR (role = 'group' AND element = 'g') OR (role = 'asset' AND element IN ('image', 'g')))")
def f10(spark, sf):
    given = F.expr("CASE WHEN sibling_order % 7 = 0 THEN 'circle' WHEN sibling_order % 7 = 1 THEN 'text' ELSE element END")
    return M.role_element_mismatches(tree_nodes(spark, sf).withColumn("element", given)).select("id", "role", "element")


@query("f11_f12_points_and_bounds", "SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 15 AS inside, isfinite(c_acctbal) AS finite FROM customer")
def f11(spark, sf):
    inside = S.point_in("c_acctbal", "c_nationkey", F.lit(0), F.lit(5), F.lit(5000), F.lit(10))
    return table(spark, sf, "customer").select("c_custkey", inside.alias("inside"), S.is_finite("c_acctbal").alias("finite"))


@query("f14_x6_withheld_documents", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 300 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)")
def f14(spark, sf):
    """Diagnostics of several stages in one table; one anti join withholds documents with an error."""
    docs = table(spark, sf, "documents")
    short = docs.where("n_chars < 300").select("doc_id", F.lit("error").alias("severity"), F.lit("SHORT").alias("code"))
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("fatal").alias("severity"))
    mild = docs.select("doc_id", F.lit("warning").alias("severity"))
    return M.gated(docs.select("doc_id", "lang"), short.unionByName(toxic, allowMissingColumns=True).unionByName(mild, allowMissingColumns=True))


@query("f19_safe_part_names", r"SELECT page_id, NOT regexp_matches(n, '(^/)|(^|/)[.][.](/|$)|\\') AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ppt/' || page_id WHEN 1 THEN '../' || page_id WHEN 2 THEN '/abs' ELSE 'a/../b' END AS n FROM pages)")
def f19(spark, sf):
    name = F.expr("CASE page_id % 4 WHEN 0 THEN concat('ppt/', page_id) WHEN 1 THEN concat('../', page_id) WHEN 2 THEN '/abs' ELSE 'a/../b' END")
    return table(spark, sf, "pages").select("page_id", S.safe_part_name(name).alias("safe"))


@query("c6_newlines", "SELECT doc_id, length(text) AS n FROM documents")
def c6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(S.normalise_newlines(F.replace("text", F.lit("\n"), F.lit("\r\n")))).cast("long").alias("n"))


@query("c15_translate", r"SELECT p_partkey, (p_size * 1.5)::DOUBLE AS tx, CASE WHEN p_partkey % 2 = 0 THEN -p_size::DOUBLE ELSE 0 END AS ty FROM part")
def c15(spark, sf):
    text = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('translate(', p_size * 1.5D, ', -', p_size, ')') ELSE concat('translate(', p_size * 1.5D, ')') END")
    return table(spark, sf, "part").select("p_partkey", S.translation(text).alias("t")).select("p_partkey", "t.*")


@query("c16_exact_decimal_products", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity::DECIMAL(18,4) * l_discount::DECIMAL(18,4)) = (l_tax::DECIMAL(18,4) * (l_linenumber * 10)::DECIMAL(18,4)) AS same, (l_quantity::DECIMAL(30,10) - l_tax::DECIMAL(30,10))::DOUBLE AS difference FROM lineitem")
def c16(spark, sf):
    """Whether quantity to tax is as ten times the line number to discount, without a division."""
    ten = (F.col("l_linenumber") * 10).cast("string")
    text = {c: F.round(c, 2).cast("decimal(18,2)").cast("string") for c in ("l_quantity", "l_discount", "l_tax")}
    same = S.exact_products_equal(text["l_quantity"], text["l_discount"], text["l_tax"], ten)
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", same.alias("same"), S.exact_difference(text["l_quantity"], text["l_tax"]).cast("double").alias("difference"))


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("c19_placement", "SELECT vec_id, (vec_id % 100) * 0.5::DOUBLE + 12 AS x, (vec_id % 70) * 0.5::DOUBLE + 7 AS y FROM embeddings")
def c19(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", S.placed(F.col("vec_id") % 100, 0.5, 12).alias("x"), S.placed(F.col("vec_id") % 70, F.lit(0.5), F.lit(7.0)).alias("y"))


@query("c23_code_points", "SELECT p_partkey, list_sort(list_distinct(list_transform(string_split(p_name, ''), lambda c: unicode(c)))) AS points FROM part")
def c23(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.code_points("p_name").alias("points"))


@query("c32_slices", "SELECT doc_id, substr(text, 3, 7) AS part, hex(encode(text)[3:9]) AS bytes FROM documents")
def c32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.text_slice("text", 2, 9).alias("part"), F.hex(S.byte_slice("text", 2, 9)).alias("bytes"))


@query("c33_preview", "WITH c AS (SELECT doc_id, unnest(string_split(left(replace(text, chr(7), '?'), 512), '')) AS ch, generate_subscripts(string_split(left(replace(text, chr(7), '?'), 512), ''), 1) AS i FROM documents), s AS (SELECT *, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS size FROM c) SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(string_agg(ch, '' ORDER BY i) FILTER (size <= 512), '') END AS shown FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, text")
def c33(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.preview("text").alias("shown"))


@query("c34_toggle_cascade", "SELECT p_partkey, coalesce(CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, CASE p_size % 2 WHEN 0 THEN true END, false) AS bold FROM part")
def c34(spark, sf):
    """Own property, then the style's, then the document's default; null says nothing."""
    own = F.when(F.col("p_partkey") % 3 == 0, True).when(F.col("p_partkey") % 3 == 1, False)
    return table(spark, sf, "part").select("p_partkey", S.toggle(own, F.when(F.col("p_size") % 2 == 0, True)).alias("bold"))


@query("c29_file_versions", "SELECT p_partkey, 'C-' || p_size AS id, (p_partkey % 9)::INT AS major, (p_partkey % 12)::INT AS minor FROM part")
def c29(spark, sf):
    name = F.expr("concat('C-', p_size, '.', p_partkey % 9, '.', p_partkey % 12, '.md')")
    return table(spark, sf, "part").select("p_partkey", S.file_version(name).alias("v")).select("p_partkey", "v.*")


@query("c30_timestamps", "SELECT o_orderkey, o_orderkey % 3 = 0 AS ok FROM orders")
def c30(spark, sf):
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '2024-02-29T10:00:00Z' WHEN 1 THEN '2024-02-30T10:00:00Z' ELSE '2024-02-29 10:00' END")
    return table(spark, sf, "orders").select("o_orderkey", S.is_rfc3339(text).alias("ok"))


@query("o5_natural_part_order", "SELECT p_partkey, p_size::BIGINT AS number FROM part")
def o5(spark, sf):
    """slide10 after slide9: the number in the name decides."""
    return table(spark, sf, "part").select("p_partkey", S.part_number(F.concat(F.lit("ppt/slide"), F.col("p_size").cast("string"), F.lit(".xml"))).alias("number"))


@query("o11_purpose_text", r"SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE regexp_extract(left(t, 161), '^(.*)\s', 1) END AS purpose FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)")
def o11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.shortened(F.split("text", "\n")[0]).alias("purpose"))


@query("o12_history_limit", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def o12(spark, sf):
    return I.newest(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ("ts", "event_id"), 5).select("user_id", "event_id")


@query("o13_first_match", "SELECT conv_id, arg_min(text, turn) AS first_answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def o13(spark, sf):
    return I.first_match(table(spark, sf, "conversations"), "conv_id", "turn", "text", "role = 'assistant'").withColumnRenamed("text", "first_answer")


@query("x4_required_subset", "SELECT conv_id, list_has_all(list(role), ['user', 'assistant']) AS has_all FROM conversations GROUP BY conv_id")
def x4(spark, sf):
    return I.has_all(table(spark, sf, "conversations"), "conv_id", "role", ("user", "assistant"))


@query("x5_seen_ledger", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 100 = 0)")
def x5(spark, sf):
    """What is new against a ledger of what was seen; the stream has the same rule."""
    events = table(spark, sf, "events")
    return I.unseen(events, events.where("event_id % 100 = 0"), "user_id")


@query("j13_tokens_by_theme_and_property", "WITH u AS (SELECT DISTINCT p_brand AS property, 't' || p_size % 5 AS token FROM part), th AS (SELECT DISTINCT p_type AS theme_id, 't' || p_size % 5 AS token, min(p_partkey) OVER (PARTITION BY p_type, p_size % 5) AS expression FROM part) SELECT u.property, u.token, th.theme_id, th.expression % 2 = 0 AS valid FROM u JOIN th USING (token)")
def j13(spark, sf):
    part = table(spark, sf, "part")
    uses = part.selectExpr("p_brand AS property", "concat('t', p_size % 5) AS token")
    themes = part.selectExpr("p_type AS theme_id", "concat('t', p_size % 5) AS token", "p_partkey").groupBy("theme_id", "token").agg(F.min("p_partkey").alias("expression"))
    return Y.token_uses(uses, themes, F.col("expression") % 2 == 0)


@query("j15_font_faces", "SELECT p_partkey, s.s_name AS face FROM part LEFT JOIN (SELECT lower('Face ' || s_nationkey) AS family, s_nationkey % 3 * 100 AS weight, min(s_name) AS s_name FROM supplier GROUP BY ALL) s ON s.family = lower('face ' || p_size) AND s.weight = p_partkey % 3 * 100")
def j15(spark, sf):
    """Lookup by family (whatever its case and quotes), weight and style; a miss stays unmeasured."""
    lines = table(spark, sf, "part").selectExpr("p_partkey", "concat('\"face ', p_size, '\"') AS family", "p_partkey % 3 * 100 AS weight", "'normal' AS style")
    faces = table(spark, sf, "supplier").selectExpr("concat('Face ', s_nationkey) AS family", "s_nationkey % 3 * 100 AS weight", "'normal' AS style", "s_name").groupBy("family", "weight", "style").agg(F.min("s_name").alias("face"))
    return M.with_faces(lines, faces).select("p_partkey", "face")


@query("j23_duplicate_fingerprints", "SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS baseline FROM documents GROUP BY ALL HAVING count(*) = 2")
def j23(spark, sf):
    return I.fingerprint_groups(table(spark, sf, "documents"), F.md5("text"), "doc_id", 2)


@query("j26_broken_references", "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+) the', 1)) AS name FROM documents) SELECT doc_id, name FROM r WHERE name NOT IN (SELECT name FROM r WHERE doc_id % 2 = 0)")
def j26(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("line"), "text")
    found = R.references(lines, "([A-Z][a-z]+) the")
    return R.broken_references(found, found.where("path % 2 = 0")).select(F.col("path").alias("doc_id"), "name")


@query("j27_zombies_and_shadows", "WITH s AS (SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderkey % 3 = 0), i AS (SELECT c_custkey AS name FROM customer WHERE c_custkey % 4 <> 1) SELECT coalesce(s.name, i.name) AS name, CASE WHEN i.name IS NULL THEN 'zombie' ELSE 'shadow' END AS state FROM s FULL JOIN i ON s.name = i.name WHERE s.name IS NULL OR i.name IS NULL")
def j27(spark, sf):
    return R.zombies_and_shadows(table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_custkey AS name"), table(spark, sf, "customer").where("c_custkey % 4 <> 1").selectExpr("c_custkey AS name"))


@query("a20_a21_package_sizes", "SELECT source AS package, (sum(strlen(text) + 2 * strlen('word/' || doc_id || '.xml') + 76) + 22)::BIGINT AS archive_size, count(*) AS n_parts FROM documents GROUP BY source")
def a20(spark, sf):
    """The same bytes as the written archives have."""
    parts = table(spark, sf, "documents").select(F.col("source").alias("package"), F.concat(F.lit("word/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return P.archive_sizes(parts)


@query("k9_written_archives", "SELECT source AS package, (sum(strlen(text) + 2 * strlen('word/' || doc_id || '.xml') + 76) + 22)::BIGINT AS archive_size, count(*) AS n_parts, sum(strlen(text))::BIGINT AS content_size FROM documents GROUP BY source")
def k9(spark, sf):
    """Archives are written and read again in pieces: their size, their parts and what the parts hold."""
    parts = table(spark, sf, "documents").select(F.col("source").alias("package"), F.concat(F.lit("word/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    pieces = SharedTables(spark, "written").cut("pieces", P.write_pieces(parts))
    sizes = pieces.groupBy("package").agg(F.sum(F.octet_length("content")).alias("archive_size"))
    read = P.read_pieces(pieces).where("problem IS NULL").groupBy("package").agg(F.count("*").alias("n_parts"), F.sum("size").alias("content_size"))
    return sizes.join(read, "package")


@query("a29_combined_evidence", "SELECT p_partkey, ['clear', 'near-limit', 'unverified', 'overflow'][greatest(p_partkey % 4, p_size % 4) + 1] AS status FROM part")
def a29(spark, sf):
    order = F.array(*[F.lit(x) for x in ("clear", "near-limit", "unverified", "overflow")])
    pick = lambda c: F.element_at(order, (F.expr(c) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", Y.worst_of(pick("p_partkey % 4"), pick("p_size % 4")).alias("status"))


@query("o7_children_in_order", "SELECT o_custkey AS parent_id, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS children FROM orders GROUP BY ALL")
def o7(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_custkey AS parent_id", "o_orderkey AS id", "o_orderdate AS sibling_order")
    return C.child_orders(orders)


SETTER_CASES = {"set-object-geometry": "geometry", "set-native-style": "style", "set-text": "text", "set-active-theme": "active_theme", "set-group-translation": "transform", "set-text-frame": "frame", "set-connector-endpoints": "relationship"}
_CASES = list(SETTER_CASES)
_PICK = " ".join(f"WHEN {i} THEN '{op}'" for i, op in enumerate(_CASES))


def _settable(spark, sf):
    """Orders as objects that have every field that an operation sets."""
    fields = [F.concat(F.lit(f"{c}-"), F.col("o_orderstatus")).alias(c) for c in SETTER_CASES.values()]
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), *fields)


@query("m2_m4_m5_m7_m8_every_setter", "WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS i, o_orderstatus AS v, o_orderkey % 5 = 0 AS hit FROM orders) SELECT id, " + ", ".join(f"CASE WHEN hit AND i = {i} THEN 'new' ELSE '{c}-' || v END AS {c}" for i, c in enumerate(SETTER_CASES.values())) + " FROM o")
def m2(spark, sf):
    """Every operation that sets a field, the active theme among them."""
    nodes = _settable(spark, sf)
    op = F.expr(f"CASE id % 7 {_PICK} END")
    old = F.expr("CASE id % 7 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SETTER_CASES.values())) + " END")
    return E.apply_operations(nodes, nodes.where("id % 5 = 0").select(F.col("id").alias("seq"), op.alias("op"), "id", old.alias("old"), F.lit("new").alias("new")))[0]


@query("m2_m13_stale_setters", f"SELECT o_orderkey AS id, CASE o_orderkey % 7 {_PICK} END AS op, CASE WHEN o_orderkey % 3 = 0 THEN 'stale-value' ELSE 'ok' END AS verdict FROM orders")
def m13(spark, sf):
    nodes = _settable(spark, sf)
    now = F.expr("CASE id % 7 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SETTER_CASES.values())) + " END")
    ops = nodes.select(F.col("id").alias("seq"), F.expr(f"CASE id % 7 {_PICK} END").alias("op"), "id", F.when(F.col("id") % 3 == 0, "else").otherwise(now).alias("old"), F.lit("new").alias("new"))
    return E.check_operations(nodes, ops).select("id", "op", "verdict")


@query("m6_clone_connectors", "WITH e AS (SELECT o_orderkey AS id, o_custkey AS from_id, o_custkey + 1 AS to_id, o_orderstatus AS style FROM orders) SELECT * FROM e UNION ALL SELECT -id, to_id, from_id, style FROM e WHERE id % 10 = 1 AND to_id IN (SELECT c_custkey FROM customer)")
def m6(spark, sf):
    edges = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS from_id", "o_custkey + 1 AS to_id", "o_orderstatus AS style")
    nodes = table(spark, sf, "customer").selectExpr("c_custkey AS id")
    clones = edges.where("id % 10 = 1").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return E.clone_connectors(edges, clones.selectExpr("id", "-id AS new_id", "to_id AS from_id", "from_id AS to_id"), nodes)[0]


@query("m6_refused_clones", "WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE -o_orderkey END AS new_id, CASE WHEN o_orderkey % 4 = 1 THEN -5 ELSE o_custkey END AS from_id, o_custkey AS to_id FROM orders) SELECT id, new_id, from_id, to_id, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'unknown-target' WHEN id % 4 = 0 THEN 'id-taken' WHEN from_id = -5 THEN 'unknown-endpoint' ELSE 'ok' END AS verdict FROM c")
def m6_refused(spark, sf):
    orders = table(spark, sf, "orders")
    edges = orders.where("o_orderkey % 2 = 1 OR o_orderkey % 4 = 0").selectExpr("o_orderkey AS id", "o_custkey AS from_id", "o_custkey AS to_id")
    clones = orders.selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE -o_orderkey END AS new_id", "CASE WHEN o_orderkey % 4 = 1 THEN -5 ELSE o_custkey END AS from_id", "o_custkey AS to_id")
    return E.clone_connectors(edges, clones, table(spark, sf, "customer").selectExpr("c_custkey AS id"))[1]


@query("k11_c27_o6_canonical_json", "SELECT event_id, '{\"a\":{\"b\":' || event_id || ',\"z\":[2,1]},\"value\":' || (event_id % 7) || '}' AS body FROM events")
def k11(spark, sf):
    """Keys in order at every level, lists as they are, whole numbers without a point."""
    text = F.format_string('{ "value" : %d.0, "a": {"z": [2, 1], "b": %d} }', F.col("event_id") % 7, F.col("event_id"))
    return table(spark, sf, "events").select("event_id", J.canonical_json(text).alias("body"))


@query("a11_s15_metadata_verdicts", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'repeated-key' WHEN 2 THEN 'too-deep' WHEN 3 THEN 'not-json' ELSE 'too-large' END AS verdict FROM events")
def a11(spark, sf):
    """Metadata of at most 4,096 bytes and depth 4, without repeated keys."""
    text = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"a": {"b": {"c": {"d": 1}}}}' WHEN 1 THEN '{"a": 1, "b": {"x": 1, "x": 2}}' WHEN 2 THEN '{"a": {"b": {"c": {"d": {"e": 1}}}}}' WHEN 3 THEN '{"a": ' ELSE concat('{"a": "', repeat('x', 4096), '"}') END""")
    return table(spark, sf, "events").select("event_id", J.metadata_verdict(text).alias("verdict"))


@query("o10_bounded_messages", "SELECT doc_id, CASE WHEN length(text) <= 4096 THEN text ELSE left(text, 4095) || chr(8230) END AS message FROM documents")
def o10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.bounded_message("text").alias("message"))


@query("c4_wrapped_markers", "SELECT p_partkey, CASE WHEN trim(t) = '' THEN t ELSE '  **' || p_name || '** ' END AS wrapped FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN '   ' ELSE '  ' || p_name || ' ' END AS t FROM part)")
def c4(spark, sf):
    text = F.expr("CASE WHEN p_partkey % 5 = 0 THEN '   ' ELSE concat('  ', p_name, ' ') END")
    return table(spark, sf, "part").select("p_partkey", S.wrap_marker(text, "**").alias("wrapped"))


@query("f21_missing_headers", "SELECT doc_id AS path FROM documents WHERE NOT list_bool_or([contains(l, 'the') FOR l IN string_split(text, chr(10))[1:15]])")
def f21(spark, sf):
    lines = R.file_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"))
    return R.missing_headers(lines, "the")


@query("j28_broken_links", "SELECT 'docs/' || o_custkey || '.md' AS path, o_orderkey AS line, CASE o_orderkey % 3 WHEN 0 THEN 'docs/' || o_custkey || '.md' WHEN 1 THEN 'c' || o_custkey || '.md' ELSE 'docs/no/' || o_orderkey END AS target FROM orders WHERE o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")
def j28(spark, sf):
    """Links to a file beside, to one a folder up, and to what is nowhere."""
    link = F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('[x](./', o_custkey, '.md#part)') WHEN 1 THEN concat('[y](../c', o_custkey, '.md \"title\")') ELSE concat('[z](no/', o_orderkey, ') and [web](https://x.y)') END")
    lines = table(spark, sf, "orders").select(F.expr("concat('docs/', o_custkey, '.md')").alias("path"), F.col("o_orderkey").alias("line"), link.alias("text"))
    files = table(spark, sf, "orders").selectExpr("concat('docs/', o_custkey, '.md') AS path").distinct().unionByName(table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("concat('c', c_custkey, '.md') AS path"))
    return R.link_targets(lines, files)


@query("f17_hidden_scopes", f"WITH {NODES_SQL} SELECT scope_id, id, text FROM nodes WHERE role = 'text' AND text IS NOT NULL")
def f17(spark, sf):
    return O.extract_text(tree_nodes(spark, sf), include_hidden=True)


def _ellipsis_width(texts):
    """A measurer for the query below: seven units a character, and none for texts that begin with a vowel."""
    return [None if t[:1] in "aeiou" else len(t) * 7.0 for t in texts]


@query("c22_measured_widths", "SELECT p_partkey, CASE WHEN left(p_name, 1) IN ('a', 'e', 'i', 'o', 'u') THEN NULL ELSE length(p_name) * 7.0::DOUBLE END AS width FROM part")
def c22(spark, sf):
    return Y.measured(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text")), _ellipsis_width).select("p_partkey", "width")


@query("r1_reconciled_findings", f"WITH {SNAPSHOT_SQL} SELECT id, op, CASE WHEN op LIKE 'object%' THEN 'refused' WHEN op = 'set-native-style' THEN 'review' ELSE 'auto-fixable' END AS disposition FROM (SELECT l.id, op FROM lefts l JOIN rights r USING (id), LATERAL (VALUES ('set-text', l.text, r.text), ('set-object-geometry', l.geometry::VARCHAR, r.geometry::VARCHAR), ('set-native-style', l.style, r.style)) v(op, old, new) WHERE old IS DISTINCT FROM new UNION ALL SELECT id, 'object-missing' FROM lefts WHERE id NOT IN (SELECT id FROM rights) UNION ALL SELECT id, 'object-new' FROM rights WHERE id NOT IN (SELECT id FROM lefts))")
def r1(spark, sf):
    return C.reconcile(*order_snapshots(spark, sf), RECONCILED, ("set-native-style",))[1].select("id", "op", "disposition")


RECONCILED = {"text": "set-text", "geometry": "set-object-geometry", "style": "set-native-style"}


@query("r1_reconcile_status", f"WITH {SNAPSHOT_SQL}, o AS (SELECT op FROM lefts l JOIN rights r USING (id), LATERAL (VALUES ('set-text', l.text, r.text), ('set-object-geometry', l.geometry::VARCHAR, r.geometry::VARCHAR), ('set-native-style', l.style, r.style)) v(op, old, new) WHERE old IS DISTINCT FROM new), g AS (SELECT (SELECT count(*) FROM lefts WHERE id NOT IN (SELECT id FROM rights)) + (SELECT count(*) FROM rights WHERE id NOT IN (SELECT id FROM lefts)) AS n) SELECT count(*) FILTER (op <> 'set-native-style') AS n_auto_fixable, count(*) FILTER (op = 'set-native-style') AS n_review, (SELECT n FROM g) AS n_refused, CASE WHEN (SELECT n FROM g) > 0 THEN 'refused' ELSE 'review-required' END AS status FROM o")
def r1_status(spark, sf):
    return C.reconcile(*order_snapshots(spark, sf), RECONCILED, ("set-native-style",))[2].select("n_auto_fixable", "n_review", "n_refused", "status")


@query("r1_unproven_fields", f"WITH {SNAPSHOT_SQL} SELECT l.id, field, wanted, got FROM lefts l JOIN rights r USING (id), LATERAL (VALUES ('text', r.text, l.text), ('geometry', r.geometry::VARCHAR, l.geometry::VARCHAR), ('style', r.style, l.style)) v(field, wanted, got) WHERE wanted IS DISTINCT FROM got AND l.id % 5 = 0")
def r1_proof(spark, sf):
    """Operations of every fifth order are lost, and just these fail the proof."""
    left, right = order_snapshots(spark, sf)
    return C.unproven(left, right, RECONCILED, ops=C.candidate_operations(left, right, RECONCILED).where("id % 5 <> 0"))


@query("f6_f7_f8_every_quoting", r"""WITH t AS (SELECT doc_id, doc_id % 3 AS q FROM documents) SELECT doc_id, code, 1::BIGINT AS n FROM t, (VALUES ('EVENT-HANDLER'), ('UNSAFE-URL'), ('FORBIDDEN-ELEMENT')) c(code) UNION ALL SELECT doc_id, 'UNSAFE-CSS', 1 FROM t WHERE q < 2""")
def f6_quoting(spark, sf):
    """The same findings whatever the quotes; an unquoted style cannot hold the space before its parenthesis."""
    quote = F.element_at(F.array(F.lit('"'), F.lit("'"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    tag = F.concat(F.lit("<P title='a > b' ONclick="), quote, F.lit("x()"), quote, F.lit(" style="), quote, F.when(F.col("doc_id") % 3 < 2, "a: url (x)").otherwise("a:b"), quote, F.lit(">t</p><a href="), quote, F.lit("http://x/y"), quote, F.lit("><a href='#here'><sCript>"))
    return D.security_findings(table(spark, sf, "documents").select("doc_id", tag.alias("html")), "doc_id", "html")
