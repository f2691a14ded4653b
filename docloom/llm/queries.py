"""The numbered queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontamination import find_leaks
from docloom.llm.language_id import identify_languages
from docloom.llm.lm_scoring import score_language_model
from docloom.llm.mixing import mix_sources
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.personal_data import BASE, find_personal_data
from docloom.llm.prefix_trie import conversation_trie
from docloom.llm.quality_crf import score_quality
from docloom.llm.quality_rules import quality_rules
from docloom.llm.sequence_packing import pack_sequences
from docloom.llm.substring_dedup import remove_repeated_spans
from docloom.llm.token_counts import count_tokens
from docloom.llm.vector_codes import vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_language_model(_table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) AS long)").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_spans(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), openings=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    listed = ",".join(str(x) for book in books for entry in book for x in entry)
    return codes.withColumn("codebooks_sha256", F.sha2(F.lit(listed), 256))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of the codebooks one after another."""
    away = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = "a{0} AS MATERIALIZED (SELECT rid, p, x, min(struct_pack(d := {1}, e := e)) AS best FROM parts JOIN book{0} USING (p) GROUP BY rid, p, x)"
    move = """book{1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{0} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{0}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) m
  ON m.p = b.p AND m.e = b.e)"""
    steps = [near.format(0, away)]
    for r in range(rounds):
        steps += [move.format(r, r + 1), near.format(r + 1, away)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_crf": op6_quality_crf,
    "op7_mix_sources": op7_mix_sources,
    "op8_personal_data": op8_personal_data,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_pack_sequences": op11_pack_sequences,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op2_lm_scoring": r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS c,
         generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i
  FROM documents),
g AS (
  SELECT doc_id, i, c, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT c, count(*) AS n FROM g GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
whole AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id,
    CASE WHEN three.n >= 2 THEN 3 WHEN two.n >= 2 THEN 2 ELSE 1 END AS level,
    CASE WHEN three.n >= 2 THEN ln(three.n / ab.n)
         WHEN two.n >= 2 THEN ln(two.n / b.n) + CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(one.n / whole.n) + CASE WHEN g.b IS NULL THEN 0 WHEN g.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS score
  FROM g CROSS JOIN whole JOIN one USING (c)
  LEFT JOIN two ON two.b = g.b AND two.c = g.c LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c
  LEFT JOIN two ab ON ab.b = g.a AND ab.c = g.b LEFT JOIN one b ON b.c = g.b)
SELECT d.doc_id, count(s.level) AS n_words, count(*) FILTER (level = 1) AS n_order1, count(*) FILTER (level = 2) AS n_order2,
       count(*) FILTER (level = 3) AS n_order3, round(coalesce(sum(score), 0), 6) AS log_score, round(sum(score) / count(s.level), 6) AS mean_log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op7_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM by_source),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lv,
         row_number() OVER (ORDER BY cap / w, r) AS turn
  FROM ranked WINDOW p AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT * EXCLUDE (lv), (SELECT arg_min(lv, turn) FROM filled WHERE lv * w <= cap) AS lv FROM filled),
targets AS (SELECT *, least(cap, lv * w) AS target FROM levelled),
bounds AS (
  SELECT *, greatest(sum(target) OVER (), 1.0) AS whole,
         coalesce(sum(target) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(sum(target) OVER (), 1.0) AS below,
         CASE WHEN lead(r) OVER (ORDER BY r) IS NULL THEN 1.0
              ELSE sum(target) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / greatest(sum(target) OVER (), 1.0) END AS above
  FROM targets),
stepped AS (SELECT *, greatest(CAST(ceil(whole / 524288) AS BIGINT), 1) AS step FROM bounds),
slots AS (SELECT t AS slot, (t + 1) * 0.6180339887498949::DOUBLE - floor((t + 1) * 0.6180339887498949::DOUBLE) AS x FROM range(524288) g(t)),
met AS (
  SELECT slot, r, source_size, target, step FROM slots JOIN stepped ON x >= below AND x < above AND target > 0 AND slot * step < whole
  UNION ALL SELECT 524288, r, source_size, target, step FROM stepped WHERE target > 0),
counted AS (SELECT *, count(*) OVER (PARTITION BY r) AS n_slots, row_number() OVER (PARTITION BY r ORDER BY slot) - 1 AS k FROM met),
worded AS (
  SELECT *, least(greatest((n_slots - 1) * step, CAST(floor(target) AS BIGINT)), CAST(ceil(target) AS BIGINT)) AS words, (1 + n_slots) // n_slots AS per FROM counted),
cut AS (SELECT *, greatest(least(n_slots * per * source_size // words, source_size), 1) AS n_blocks FROM worded WHERE words > 0),
placed AS (SELECT r, n_blocks, source_size, words, unnest(range(k * per, k * per + per)) AS turn FROM cut),
uses AS (
  SELECT r, turn % n_blocks AS block, count(*) AS uses, min(words - turn // n_blocks * source_size) AS until
  FROM placed WHERE turn * source_size < n_blocks * words GROUP BY ALL),
blocks AS (SELECT s.*, c.n_blocks FROM stepped s LEFT JOIN (SELECT r, max(n_blocks) AS n_blocks FROM cut GROUP BY r) c ON s.r = c.r),
docs AS (
  SELECT doc_id, size, k, b.r, b.source_size, b.target, b.n_blocks,
         coalesce(sum(size) OVER (PARTITION BY b.r ORDER BY ('0x' || substr(k, 1, 8))::BIGINT % 4096, k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f
  FROM sized JOIN blocks b ON sized.source IS NOT DISTINCT FROM b.source),
pieces AS (
  SELECT doc_id, k, f, r, greatest(f, block * source_size // n_blocks) AS a, least(f + size, (block + 1) * source_size // n_blocks) AS z, block
  FROM (SELECT *, unnest(range(((f + 1) * n_blocks - 1) // source_size, ((f + size) * n_blocks - 1) // source_size + 1)) AS block FROM docs WHERE size > 0 AND n_blocks IS NOT NULL)),
got AS (
  SELECT doc_id, k, f, sum((z - a) * (uses - 1) + greatest(least(z, until) - a, 0)) AS taken
  FROM pieces JOIN uses USING (r, block) GROUP BY ALL)
SELECT d.doc_id, d.size::BIGINT AS size, d.source_size, d.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM docs d LEFT JOIN got g ON d.doc_id = g.doc_id AND d.k = g.k AND d.f = g.f
""",
    "op12_conversation_trie": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, sha256(concat(length(role), ':', role, text))) AS seq FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, seq, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 6 AS h
  FROM own),
rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.seq, 1, a.h), []), list_slice(a.seq, a.h + 1, len(a.seq))) AS seq
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
passes AS MATERIALIZED (
  SELECT conv_id, d, sha256(CAST(list_slice(seq, 1, d) AS VARCHAR)) AS node, sha256(CAST(list_slice(seq, 1, d - 1) AS VARCHAR)) AS parent,
         d = len(seq) AS ends, CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS chars
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT node, d, min(conv_id) AS conv_id, CASE WHEN d > 0 THEN min(parent) END AS parent, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM passes GROUP BY node, d),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY parent, d),
below AS (
  SELECT p.node, p.d, count(*) FILTER (k.n IS NULL) AS n_leaves, CAST(sum((x.n_convs - 1) * x.chars) AS BIGINT) AS saved_tokens
  FROM nodes x LEFT JOIN kids k ON k.node = x.node AND k.d = x.d JOIN passes p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.node, p.d)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node AND b.d = n.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d LEFT JOIN nodes p ON p.node = n.parent AND p.d = n.d - 1
""",
    "op13_vector_codes": _codes_sql(),
}
