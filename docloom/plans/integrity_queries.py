"""Integrity joins, ordered checks and repository aggregates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import integrity as I
from docloom.operators import model as M
from docloom.operators import reconcile as C
from docloom.operators import repository as R
from docloom.plans.registry import query, table


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


EDGES_SQL = "edges AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS from_id, l_suppkey + 1000000 AS to_id FROM lineitem)"
IDS_SQL = "ids AS (SELECT p_partkey AS id FROM part WHERE p_size <> 7 UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_nationkey <> 3)"


def _edges(spark, sf):
    return _lines(spark, sf).selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_partkey AS from_id", "l_suppkey + 1000000 AS to_id")


@query("j6_missing_endpoints", f"WITH {EDGES_SQL}, {IDS_SQL} SELECT * FROM (SELECT id, 'from_id' AS \"end\", from_id AS missing_id FROM edges UNION ALL SELECT id, 'to_id', to_id FROM edges) WHERE missing_id NOT IN (SELECT id FROM ids)")
def j6(spark, sf):
    ids = table(spark, sf, "part").where("p_size <> 7").selectExpr("p_partkey AS id").unionByName(table(spark, sf, "supplier").where("s_nationkey <> 3").selectExpr("s_suppkey + 1000000 AS id"))
    return I.missing_endpoints(_edges(spark, sf), ids)


@query("j3_topmost_missing", "SELECT o_custkey AS parent_id, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def j3(spark, sf):
    orders = table(spark, sf, "orders")
    return I.topmost_missing(orders.selectExpr("o_custkey AS parent_id", "o_orderkey AS id"), orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS id"))


@query("j7_deletion_hazards", f"WITH {EDGES_SQL}, gone AS (SELECT p_partkey AS id FROM part WHERE p_size < 5 UNION SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 9 = 0) SELECT id, from_id, to_id FROM edges WHERE (from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone)) AND id NOT IN (SELECT id FROM gone)")
def j7(spark, sf):
    gone = table(spark, sf, "part").where("p_size < 5").selectExpr("p_partkey AS id").unionByName(table(spark, sf, "supplier").where("s_suppkey % 9 = 0").selectExpr("s_suppkey + 1000000 AS id"))
    return I.deletion_hazards(_edges(spark, sf), gone).select("id", "from_id", "to_id")


@query("j8_reference_counts", "SELECT doc_id, n_targets, CASE WHEN n_targets = 1 THEN 'resolved' WHEN n_targets = 0 THEN 'missing' ELSE 'ambiguous' END AS verdict FROM (SELECT doc_id, (SELECT count(*) FROM documents d WHERE d.doc_id = l.doc_id AND d.lang <> 'fr') AS n_targets FROM labels l)")
def j8(spark, sf):
    return I.reference_counts(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("lang <> 'fr'").select("doc_id"), "doc_id")


@query("j9_j27_unused_targets", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9(spark, sf):
    return I.unused(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("j4_x7_multiset_difference", "SELECT side, n_nationkey FROM (SELECT 'left' AS side, n_nationkey FROM (SELECT c_nationkey AS n_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'right', n_nationkey FROM (SELECT s_nationkey AS n_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer))")
def j4(spark, sf):
    return I.multiset_difference(table(spark, sf, "customer").selectExpr("c_nationkey AS n_nationkey"), table(spark, sf, "supplier").selectExpr("s_nationkey AS n_nationkey"))


@query("j5_three_way_map", "WITH a AS (SELECT p_partkey AS id FROM part), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem), c AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 <> 1), k AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c), n AS (SELECT k.id, (SELECT count(*) FROM a WHERE a.id = k.id) AS n_source, (SELECT count(*) FROM b WHERE b.id = k.id) AS n_resolved, (SELECT count(*) FROM c WHERE c.id = k.id) AS n_composed FROM k) SELECT *, CASE WHEN least(n_source, n_resolved, n_composed) = 0 THEN 'missing' WHEN greatest(n_source, n_resolved, n_composed) > 1 THEN 'duplicate' ELSE 'mapped' END AS verdict FROM n")
def j5(spark, sf):
    part = table(spark, sf, "part").selectExpr("p_partkey AS id")
    composed = table(spark, sf, "supplier").selectExpr("s_suppkey AS id").unionByName(part.where("id % 3 <> 1"))
    return I.three_way_map(part, _lines(spark, sf).selectExpr("l_partkey AS id").distinct(), composed)


@query("j18_as_of_lookup", "SELECT event_id, user_id, (SELECT max(m.value) FROM events m WHERE m.event_type = 'purchase' AND m.user_id = e.user_id AND m.ts = (SELECT max(k.ts) FROM events k WHERE k.event_type = 'purchase' AND k.user_id = e.user_id AND k.ts <= e.ts)) AS last_value FROM events e WHERE event_type = 'view'")
def j18(spark, sf):
    events = table(spark, sf, "events")
    marks = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return I.as_of(events.where("event_type = 'view'").select("event_id", "user_id", "ts"), marks, "user_id", "ts", "last_value").select("event_id", "user_id", "last_value")


RANGES_SQL = "ranges AS (SELECT l_orderkey AS scope, l_linenumber AS n, (l_partkey % 97)::INT AS s, (l_partkey % 97 + l_suppkey % 12)::INT AS e FROM lineitem)"


@query("j19_overlapping_edits", f"WITH {RANGES_SQL} SELECT scope, n, s AS start, e AS \"end\" FROM (SELECT *, lag(e) OVER w AS pe, lag(s) OVER w AS ps FROM ranges WINDOW w AS (PARTITION BY scope ORDER BY s, e, n)) WHERE pe > s OR (ps = s AND s = e AND pe = s)")
def j19(spark, sf):
    ranges = _lines(spark, sf).selectExpr("l_orderkey AS scope", "l_linenumber AS n", "CAST(l_partkey % 97 AS INT) AS start", "CAST(l_partkey % 97 + l_suppkey % 12 AS INT) AS end")
    return I.overlapping(ranges, "scope", ties=("n",))


@query("j20_contained_ranges", f"WITH {RANGES_SQL} SELECT scope, n, s AS start, e AS \"end\" FROM ranges r WHERE EXISTS (SELECT 1 FROM (SELECT o_orderkey AS scope, (o_custkey % 60)::INT AS s, (o_custkey % 60 + 40)::INT AS e FROM orders) o WHERE o.scope = r.scope AND r.s >= o.s AND r.e <= o.e)")
def j20(spark, sf):
    inner = _lines(spark, sf).selectExpr("l_orderkey AS scope", "l_linenumber AS n", "CAST(l_partkey % 97 AS INT) AS start", "CAST(l_partkey % 97 + l_suppkey % 12 AS INT) AS end")
    outer = table(spark, sf, "orders").selectExpr("o_orderkey AS scope", "CAST(o_custkey % 60 AS INT) AS start", "CAST(o_custkey % 60 + 40 AS INT) AS end")
    return I.contained(inner, outer, "scope")


@query("j29_metric_drift", "WITH c AS (SELECT event_type AS metric, count(*) AS value FROM events GROUP BY ALL), d AS (SELECT metric, CASE WHEN metric = 'click' THEN value + 1 ELSE value END AS value FROM c WHERE metric <> 'view') SELECT c.metric, c.value AS computed, d.value AS documented, CASE WHEN d.value IS NULL THEN 'NEW' WHEN d.value = c.value THEN 'OK' ELSE 'DRIFT' END AS state FROM c LEFT JOIN d USING (metric)")
def j29(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    known = counts.where("metric <> 'view'").withColumn("value", F.expr("CASE WHEN metric = 'click' THEN value + 1 ELSE value END"))
    return I.drift(known, counts, "metric", "value")


@query("w16_latest_version", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w16(spark, sf):
    return I.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("a27_next_free_number", "WITH n AS (SELECT DISTINCT l_partkey AS n FROM lineitem WHERE l_partkey % 41 <> 17) SELECT (SELECT max(n) + 1 FROM n) AS after_last, (SELECT min(g.i) FROM range(1, 100000) g(i) WHERE g.i NOT IN (SELECT n FROM n)) AS smallest_free")
def a27(spark, sf):
    return I.next_free(_lines(spark, sf).where("l_partkey % 41 <> 17"), "l_partkey")


@query("w4_w5_adjacent_runs", "WITH t AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, run::BIGINT AS run, min(role) AS value, min(turn) AS first, max(turn) AS last, count(*) AS size FROM r GROUP BY conv_id, run")
def w4(spark, sf):
    return I.run_lengths(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role"))


@query("w9_section_order", "SELECT conv_id, turn, rank FROM (SELECT *, max(rank) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM (SELECT conv_id, turn, (length(text) % 5)::INT AS rank FROM conversations)) WHERE high > rank")
def w9(spark, sf):
    return I.out_of_order(table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CAST(length(text) % 5 AS INT) AS rank"), "conv_id", "turn", "rank")


@query("w12_contiguous_order", "SELECT l_orderkey, bool_and(l_linenumber = k) AS contiguous FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) GROUP BY ALL")
def w12(spark, sf):
    return I.contiguous(_lines(spark, sf), "l_orderkey", "l_linenumber")


@query("w8_output_ranges", "SELECT l_orderkey, l_linenumber, (l_partkey + coalesce(sum(l_suppkey % 7 - 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS out_start FROM lineitem")
def w8(spark, sf):
    edits = _lines(spark, sf).withColumn("delta", F.expr("l_suppkey % 7 - 3"))
    return I.output_ranges(edits, "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_partkey", "delta").select("l_orderkey", "l_linenumber", "out_start")


@query("w11_quiescence", "WITH t AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r) SELECT user_id, event_id FROM k WHERE n = 3")
def w11(spark, sf):
    """The third of equal observations in a row, per user; the stream has the same rule."""
    return I.nth_in_a_row(table(spark, sf, "events"), "user_id", ("ts", "event_id"), "event_type").select("user_id", "event_id")


@query("a3_a4_findings_pivot", "SELECT event_type, count(*) FILTER (value > 50) AS n_refused, count(*) FILTER (value <= 50) AS n_auto, coalesce(sum(event_id % 5) FILTER (value > 50), 0)::BIGINT AS occurrences FROM events GROUP BY ALL")
def a3(spark, sf):
    return C.occurrences_by(table(spark, sf, "events"), "event_type", F.col("value") > 50, F.col("event_id") % 5)


@query("a5_highest_disposition", "SELECT o_custkey, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY ALL")
def a5(spark, sf):
    return C.highest(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")


@query("a12_a13_occurrence_status", "SELECT c_custkey, n_orders, CASE WHEN n_orders = 0 THEN 'missing' WHEN n_orders = 1 THEN 'unique' ELSE 'duplicate' END AS status FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer)")
def a12(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return I.occurrence_status(table(spark, sf, "customer"), orders, "c_custkey").withColumnRenamed("n", "n_orders")


@query("a14_grouped_ids", "SELECT p_brand, p_size, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids, count(*) AS n FROM part GROUP BY ALL")
def a14(spark, sf):
    return I.grouped_ids(table(spark, sf, "part"), ("p_brand", "p_size"), "p_partkey")


@query("a22_a23_a25_lifecycle_counts", "SELECT source, count(*) AS n, count(*) FILTER (n_chars < 500) AS n_draft, count(DISTINCT lang) AS n_langs FROM documents GROUP BY ALL")
def a22(spark, sf):
    return R.contract_counts(table(spark, sf, "documents"), "source", F.col("n_chars") < 500, "lang").withColumnRenamed("n_owners", "n_langs")


@query("a24_prefix_collisions", "SELECT left(p_name, 5) AS prefix, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS owners, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def a24(spark, sf):
    return R.prefix_collisions(table(spark, sf, "part"), F.left("p_name", F.lit(5)), "p_brand")


@query("a26_stale_documents", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02')::INT AS age FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 900")
def a26(spark, sf):
    """The day of the check is a parameter, never the clock."""
    return R.stale(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("verified")), "1998-08-02", 900, "verified").select("o_orderkey", "age")


@query("a30_marker_counts", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) FILTER (regexp_matches(line, '[A-Z]{4,}')) AS n_todo, count(*) FILTER (regexp_matches(line, '[A-Z]{4,}') AND contains(line, '!')) AS n_tracked, count(*) FILTER (regexp_matches(line, '[A-Z]{4,}') AND NOT contains(line, '!')) AS n_untracked FROM l")
def a30(spark, sf):
    lines = R.file_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"))
    return R.todo_counts(lines, "[A-Z]{4,}", "!")


@query("a31_lifecycle_ladder", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'draft' WHEN n > 0 AND c_custkey % 4 > 0 THEN 'implemented' WHEN c_custkey % 4 > 0 THEN 'testing' ELSE 'active' END AS state FROM (SELECT c_custkey, c_nationkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)")
def a31(spark, sf):
    n = a12(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return n.select("c_custkey", R.lifecycle(F.col("n_orders"), F.col("c_custkey") % 4, F.col("c_nationkey") % 3 != 0).alias("state"))


@query("a32_section_completeness", "SELECT conv_id AS path, count(DISTINCT role) FILTER (role IN ('user', 'assistant', 'system')) AS n_sections, count(DISTINCT role) FILTER (role IN ('user', 'assistant', 'system')) = 3 AS complete FROM conversations GROUP BY ALL")
def a32(spark, sf):
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), F.concat(F.lit("## "), "role", F.lit(" "), "text").alias("text"))
    return R.section_completeness(lines, ("## user", "## assistant", "## system"))


@query("a33_content_under_heading", "WITH t AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN '## ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading, role FROM conversations) SELECT conv_id AS path, heading, count(*) FILTER (role <> 'user' AND trim(text) <> '' AND text NOT LIKE '## %') AS n_content FROM t WHERE heading IS NOT NULL GROUP BY ALL")
def a33(spark, sf):
    text = F.when(F.col("role") == "user", F.concat(F.lit("## "), F.col("turn").cast("string"))).otherwise(F.col("text"))
    return R.content_by_section(table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("line"), text.alias("text")))


@query("f5_f20_name_grammars", r"SELECT doc_id, regexp_full_match(source, '[A-Za-z][A-Za-z0-9._:-]{0,127}') AS stable, regexp_full_match('2024-01-0' || (doc_id % 12) || '-' || source || '.md', '[0-9]{4}-[0-9]{2}-[0-9]{2}-[A-Za-z0-9._-]+[.]md') AS memo FROM documents")
def f5(spark, sf):
    name = F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 12).cast("string"), F.lit("-"), "source", F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", S.is_stable_id("source").alias("stable"), name.rlike(S.MEMO_NAME).alias("memo"))


@query("j22_path_alias_pairs", "SELECT a, b FROM (SELECT min(c_custkey) OVER (PARTITION BY lower(c_mktsegment), c_nationkey) AS a, c_custkey AS b FROM customer) WHERE a < b")
def j22(spark, sf):
    return I.alias_pairs(table(spark, sf, "customer"), "c_custkey", F.concat_ws("/", F.lower("c_mktsegment"), "c_nationkey"))


@query("j31_metadata_comparison", "SELECT l.doc_id AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.lang IS DISTINCT FROM 'en' THEN 'different-family' WHEN d.n_chars > 2000 THEN 'different-style' ELSE 'equal' END AS verdict FROM labels l LEFT JOIN documents d USING (doc_id)")
def j31(spark, sf):
    """An ordered ladder of verdicts over a one-to-one join."""
    wanted = table(spark, sf, "labels").select("doc_id", F.lit("en").alias("family"), F.lit(False).alias("style"))
    found = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("family"), (F.col("n_chars") > 2000).alias("style"))
    return M.compare_metadata(wanted, found, "doc_id", {"family": "different-family", "style": "different-style"})
