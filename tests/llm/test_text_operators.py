import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import queries
from docloom.llm.decontamination import RADIUS, ItemIndex, drop_leaking, find_leaks
from docloom.llm.language_id import identify_languages
from docloom.llm.lm_scoring import score_language_model
from docloom.llm.mixing import mix_sources, slot_schedule, source_targets
from docloom.llm.personal_data import BASE, find_personal_data, redacted
from docloom.llm.quality_crf import marginals, score_quality
from docloom.llm.quality_rules import quality_rules
from docloom.llm.token_counts import count_tokens
from tests.llm import brute
from tests.oracle import assert_same

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name, sf):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], f"/root/testdata/{sf}")


def test_token_counts_of_a_whole_table_equal_the_library(spark):
    sf = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_token_counts(spark, sf).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark):
    rng = random.Random(5)
    letters = "aabé .,\n\t  '’sStT1²٣½中文🙂  ‍_<|endoftext|>́ßſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    texts += ["<|endoftext|>", "x<|endoftext|>" * 3, "a" * 3000, "ab" * 2000, " " * 500, "", None]
    rows = [(i, t, None, None, 0, 1, "k", "d") for i, t in enumerate(texts)]
    library = Tokenizer.from_file(BPE)
    got = {r.doc_id: r for r in count_tokens(brute.frame(spark, rows), BPE).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)


def test_quality_counts_equal_brute_force_and_junk_goes(spark):
    clean = [r for r in brute.awkward_documents(2, 40)]
    prose = " ".join(random.Random(i).choice(["the", "of", "ananor", "tionly", "erst", "to", "in", "reded", "hathe"]) for i in range(80))
    junk = " ".join(w + "$$$" for w in prose.split())
    rows = [*clean, (90001, prose, None, None, 0, 1, "k", "d"), (90002, junk, None, None, 0, 1, "k", "d")]
    got = quality_rules(brute.frame(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        n, chars, symbols, dup, repeat = brute.base_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[90002] is False
    assert quality_rules(brute.frame(spark, [])).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for k in range(20)] + [(50, None), (51, ""), (52, "only once said")]
    rows = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            k = rng.randrange(20)
            leak = items[k][1].split(" ")
            if i % 8 == 0 and len(leak) > 20:
                leak[0] = "other"
            w[30:30] = [x.upper() for x in leak]
        rows.append((i, " ".join(w), None, None, 0, 1, "k", "d"))
    rows += [(100, None, None, None, 0, 1, "k", "d"), (101, "", None, None, 0, 1, "k", "d"), (102, "only ONCE said", None, None, 0, 1, "k", "d"), rows[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in find_leaks(brute.frame(spark, rows), bench, index_bytes=600).collect())
    expected = []
    for r in rows:
        w = brute.words(r[1], lower=True)
        for item, text in items:
            x = brute.words(text, lower=True)
            n = min(5, len(x))
            if not x:
                continue
            grams = lambda s, n=n: [tuple(s[k : k + n]) for k in range(len(s) - n + 1)]
            best = 0.0
            for p in range(len(w) - len(x) + 1):
                a, b = brute.Counter(grams(w[p : p + len(x)])), brute.Counter(grams(x))
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                expected.append((r[0], item, round(best, 9)))
    assert got == sorted(expected)
    left = {r.doc_id for r in drop_leaking(brute.frame(spark, rows), bench).collect()}
    assert left == {r[0] for r in rows} - {d for d, _, _ in expected}
    assert find_leaks(brute.frame(spark, []), bench).count() == 0
    assert find_leaks(brute.frame(spark, rows), bench.where("false")).count() == 0


def _plain_leaks(w, items):
    out = {}
    for item, x in items:
        n = min(5, len(x))
        grams = lambda s, n=n: brute.Counter(tuple(s[k : k + n]) for k in range(len(s) - n + 1))
        best = max((sum((grams(w[p : p + len(x)]) & grams(x)).values()) / sum((grams(w[p : p + len(x)]) | grams(x)).values()) for p in range(len(w) - len(x) + 1)), default=0.0)
        if best >= 0.8:
            out[item] = round(best, 9)
    return out


def test_a_phrase_that_all_items_share_costs_little():
    """Thousands of items with one stem, and a text that has the stem again and again; one item leaks for real."""
    rng = random.Random(8)
    stem = "which of the following is true".split()
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, stem + [word() for _ in range(34)]) for k in range(4000)]
    text = []
    for k in range(60):
        text += [word() for _ in range(25)] + stem
        if k == 30:
            text = text[:-6] + items[77][1][:36] + ["other"] + items[77][1][37:]
    index = ItemIndex([(k, " ".join(x)) for k, x in items], 5, RADIUS, 0.8)
    buf = np.frombuffer(" ".join(text).encode(), np.uint8)
    began = time.perf_counter()
    got = {item: round(s, 9) for _, item, s, _, _ in index.search(buf, np.array([0, len(buf)]))}
    assert time.perf_counter() - began < 1.0
    assert got == _plain_leaks(text, [items[k] for k in range(70, 90)]) and set(got) == {77}


def test_no_window_at_the_threshold_is_missed():
    """Items of all sizes with words changed until the similarity is just over or under 0.8; repeats weigh."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items, text, placed = [], [], 0
    for k in range(60):
        x = [rng.choice(words) for _ in range(rng.randint(3, 70))]
        if rng.random() < 0.3:
            x = (x[:7] * 12)[: len(x)]
        items.append((k, x))
        y = x[:]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.choice([0, len(y) - 1, rng.randrange(len(y))])
            y[at] = "changed"
        text += y + [rng.choice(words) for _ in range(3)]
        placed += 1
    index = ItemIndex([(k, " ".join(x)) for k, x in items], 5, RADIUS, 0.8)
    buf = np.frombuffer(" ".join(text).encode(), np.uint8)
    got = {item: round(s, 9) for _, item, s, _, _ in index.search(buf, np.array([0, len(buf)]))}
    expected = _plain_leaks(text, items)
    assert 20 < len(expected) < 60 and got == expected


def test_the_schedule_holds_at_any_size(spark):
    """A source of 1e15 words, where products of words and blocks pass 64 bits."""
    sizes = spark.createDataFrame([("a", 10**15), ("b", 3 * 10**14), (None, 5)], "source string, source_size long")
    targets = source_targets(sizes, 1.5, 2).withColumn("step", F.greatest(F.ceil(F.col("whole") / F.lit(4096)), F.lit(1)).cast("long"))
    uses = slot_schedule(targets, 2, 4096).join(targets.select("rank", "source_size", "target"), "rank").collect()
    blocks, taken, target = defaultdict(list), Counter(), {}
    for r in uses:
        blocks[r.rank, r.block].append(r)
        target[r.rank] = r.target
    for (rank, block), of in blocks.items():
        low, high = (k * of[0].source_size // of[0].n_blocks for k in (block, block + 1))
        taken[rank] += (high - low) * (len(of) - 1) + max(min(high, min(r.until for r in of)) - low, 0)
    assert len(target) == 3 and all(abs(taken[k] - target[k]) <= 1 for k in target)


def test_language_model_of_awkward_rows(spark):
    rows = brute.awkward_documents(4, 30)
    got = score_language_model(brute.frame(spark, rows), part_bytes=20_000).collect()
    whole = score_language_model(brute.frame(spark, rows)).collect()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_order2, r.n_order3, round(r.log_score, 9)) for r in rs)
    assert key(got) == key(whole) and len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.n_words == len(brute.words(texts[r.doc_id])) == r.n_order1 + r.n_order2 + r.n_order3
        assert (r.mean_log_score is None) == (r.n_words == 0)
    assert score_language_model(brute.frame(spark, [])).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    jumps, line = rng.normal(size=(2, 2)), np.array([0, 1, 4, 9])
    emission = rng.normal(size=9)
    got = marginals(emission, jumps, line)
    for a, b in itertools.pairwise(line):
        total, good = 0.0, np.zeros(b - a)
        for ys in itertools.product((0, 1), repeat=int(b - a)):
            w = math.exp(sum(emission[a + k] for k, y in enumerate(ys) if y) + sum(jumps[p, q] for p, q in itertools.pairwise(ys)))
            total += w
            good += w * np.array(ys)
        assert np.allclose(got[a:b], good / total)


def test_quality_scores_rank_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_quality_of_awkward_rows(spark):
    rows = brute.awkward_documents(6, 20)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, None, 0), (9999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(brute.frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = score_quality(brute.frame(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_languages_of_awkward_rows(spark):
    rows = [*brute.awkward_documents(8, 20), (70001, "123 !? ٣", None, None, 0, 1, "k", "d"), (70002, "中文", None, None, 0, 1, "k", "d")]
    got = identify_languages(brute.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    texts = {r[0]: r[1] for r in rows}
    for i, r in by.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or ""))
        assert 0 <= r.score <= 1
    nothing = identify_languages(brute.frame(spark, [r for r in rows if r[2] is None])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_mix_meets_targets(spark):
    rows = brute.awkward_documents(9, 80)
    got = mix_sources(brute.frame(spark, rows), keep=("source",)).collect()
    again = mix_sources(brute.frame(spark, rows).repartition(2), keep=("source",)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sources = sorted({r[3] for r in rows if r[3]}, key=str.encode) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    sizes = dict.fromkeys(sources, 0)
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    left, open_, target = 1.5 * sum(sizes.values()), set(sources), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    taken = dict.fromkeys(sources, 0)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sources:
        assert abs(taken[s] - target[s]) <= 5 + 0.001 * target[s]
    assert mix_sources(brute.frame(spark, [])).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(3)
    pieces = ["a", "b@", "@", "c.d", ".", "1", "2.3", "+", "+1 ", "(555) ", " ", "-", "4785380592391139", "4", "é", "🙂", "255.", "256.1.", "\n", "_", "%", "x@y.z", "12 34-5", "0012", "1.2.3.4"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [None, "", 'my token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" ok']
    rows = [(i, t, None, None, 0, 1, "k", "d") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in find_personal_data(brute.frame(spark, rows)).collect()}
    for i, t in enumerate(texts):
        expected = [(k, m.start(), m.end(), m.group()) for k in BASE for m in re.finditer(PATTERNS[k], t or "") if _valid(k, m.group())]
        assert [tuple(s) for s in got[i].base] == expected
        assert [tuple(s) for s in got[i].spans][: len(expected)] == expected
    assert [s["kind"] for s in got[len(texts) - 1].spans] == ["secret"]
    assert find_personal_data(brute.frame(spark, [])).count() == 0


def test_redaction_joins_overlapping_spans(spark):
    df = spark.createDataFrame([("é +1 234 567 8901 x a@b.c", [("phone", 2, 17), ("card", 5, 17), ("email", 20, 25)])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert df.select(redacted("text", "spans").alias("t")).first().t == "é <PHONE> x <EMAIL>"


def test_listed_digest(spark):
    row = queries.op8_personal_data(spark, "/root/testdata/sf0.001").where("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_tables(spark):
    empty = brute.frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert count_tokens(empty, BPE).count() == 0
    assert score_quality(empty, labels).count() == 0
    assert identify_languages(empty).count() == 0
    assert redacted_columns(empty) == 0


def redacted_columns(empty) -> int:
    return find_personal_data(empty, keep=("source", "key")).select(redacted("text", "spans").alias("t"), "source", "key").count()


def test_repeated_rows_and_null_ids_each_give_a_row(spark):
    rows = [(5, "Le la du de.", "fr", "a", 1, 1, "k", "d")] * 3 + [(None, "x y@z.com", None, None, 1, 1, "k", "d")] * 2
    docs = brute.frame(spark, rows)
    assert count_tokens(docs, BPE).count() == 5
    assert [r.n_words for r in quality_rules(docs).where("doc_id IS NULL").collect()] == [2, 2]
    assert find_personal_data(docs).where("size(base) = 1").count() == 2
    assert score_language_model(docs).count() == 5
    assert identify_languages(docs).where("doc_id IS NULL AND NOT held_out").count() == 2

def test_every_source_takes_its_target(spark):
    """Blocks of many words beside a source of few: ranges of the slots' common length would miss small targets."""
    big, small = " ".join(["w"] * 4000), "a b c d e f g"
    rows = [(i, big, None, "big", 0, 1, "k", "d") for i in range(1500)]
    rows += [(5000 + i, small, None, f"small{i % 3}", 0, 1, "k", "d") for i in range(40)]
    got = mix_sources(brute.frame(spark, rows), keep=("source",)).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and len(taken) == 4
    for s in taken:
        assert abs(taken[s] - target[s]) < 1, (s, taken[s], target[s])

def test_words_whose_hashes_begin_alike_are_counted_apart(spark):
    import numpy as np

    from docloom.llm.lm_scoring import _pack_keys, _unpack_keys
    from docloom.llm.textblocks import span_hashes, window_hashes, word_spans

    buf = np.frombuffer(" ".join(f"q{i}" for i in range(4_000_000)).encode(), np.uint8)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
    keys = window_hashes(span_hashes(buf, starts, ends), 1) >> np.uint64(24)
    order = np.argsort(keys, kind="stable")
    alike = order[np.flatnonzero(np.diff(keys[order]) == 0)[0] + np.arange(2)]
    rows = [(int(i), f"q{i}", None, None, 0, 1, "k", "d") for i in alike]
    assert [round(r.log_score, 9) for r in score_language_model(brute.frame(spark, rows)).collect()] == [round(math.log(1 / 2), 9)] * 2
    rng = np.random.default_rng(1)
    for size, high in ((0, 9), (1, 2**63), (2, 9), (1000, 2**63), (5000, 2**20)):
        keys = np.unique(rng.integers(0, high, size, dtype=np.uint64))
        assert np.array_equal(_unpack_keys(_pack_keys(keys)), keys)

def test_texts_shorter_than_the_item_leak(spark):
    item = [f"w{i}" for i in range(59)]
    rows = [(1, item[:56]), (2, item[3:]), (3, item[:20] + item[23:]), (4, item[:40]), (5, item[:3]), (6, item), (7, [*item[:56], "x"])]
    docs = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (8, "w1 w2 w3 w4")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs, bench).collect()}
    expected = {}
    for i, w in rows:
        for k, x in ((9, item), (8, item[1:5])):
            n = min(5, len(x))
            grams = lambda s, n=n: brute.Counter(tuple(s[k : k + n]) for k in range(len(s) - n + 1))
            windows = [w[p : p + len(x)] for p in range(max(1, len(w) - len(x) + 1))] if len(w) >= n else []
            best = max((sum((grams(a) & grams(x)).values()) / sum((grams(a) | grams(x)).values()) for a in windows), default=0)
            if best >= 0.8:
                expected[i, k] = round(best, 9)
    assert {k: round(r.similarity, 9) for k, r in got.items()} == expected and expected[1, 9] > 0.94 and (4, 9) not in expected
    assert (got[1, 9].start_word, got[1, 9].n_windows) == (0, 1)
    assert {r.doc_id for r in drop_leaking(docs, bench.where("item_id = 9")).collect()} == {i for i, _ in rows} - {i for i, k in expected if k == 9}
