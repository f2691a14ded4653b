import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm.components import connected_components
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.substring_dedup import remove_repeated_spans
from docloom.llm.textblocks import span_hashes, word_spans
from docloom.llm.workspace import Workspace
from tests.llm import brute


def test_near_duplicates_equal_brute_force(spark):
    rows = brute.awkward_documents()
    got = near_duplicates(brute.frame(spark, rows), percent=85).collect()
    expected = brute.components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_chains_of_near_copies_form_one_component(spark):
    """Many near copies of one text: links between stragglers count, not only those with the bucket's centre."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % 5):
            w[(7 * k + 29 * j) % 120] = f"edit{k}_{j}"
        rows.append((k, " ".join(w), "en", "s", 1, 1, "k", "d"))
    got = {r.doc_id: r.component_id for r in near_duplicates(brute.frame(spark, rows), percent=85).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_empty_table(spark):
    empty = brute.frame(spark, [])
    assert near_duplicates(empty).count() == 0
    assert remove_repeated_spans(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*path, *star, (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Workspace(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}


def test_repeated_spans_equal_brute_force(spark):
    rows = brute.awkward_documents(11, 120)
    got = remove_repeated_spans(brute.frame(spark, rows)).collect()
    expected = brute.without_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.n_words, r.n_removed) == (2, 0)
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id]


def test_repeats_within_one_document_stay(spark):
    text = " ".join(["a b c d e f g h i j k l m n"] * 20)
    rows = [(4, text, None, None, 1, 1, "k", "d"), (9, "start " + text, None, None, 1, 1, "k", "d")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in remove_repeated_spans(brute.frame(spark, rows)).collect()}
    assert got[4] == (0, text) and got[9] == (280, "start")


def test_word_hashes_depend_on_the_word_alone():
    text = ("alpha Beta alpha\tβ " * 50_000).encode()
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
    assert len({int(h) for h in span_hashes(buf, starts, ends)}) == 3


def test_digest_of_kept_words(spark):
    from docloom.llm import queries

    row = queries.op10_substring_dedup(spark, "/root/testdata/sf0.001").where("n_removed = 0").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").orderBy("doc_id").first()
    assert row.kept_sha256 == hashlib.sha256(" ".join(brute.words(row.text)).encode()).hexdigest()


def test_inputs_are_not_cached_by_partitioning(spark):
    rows = brute.awkward_documents(3, 30)
    one, two = ({r.doc_id: r.component_id for r in near_duplicates(d).collect()} for d in (brute.frame(spark, rows), brute.frame(spark, rows).coalesce(1).orderBy(F.desc("doc_id"))))
    assert one == two


def test_what_blocks_tell_is_spread_over_the_buckets(spark):
    """Every task has only a first block here; what it tells goes in bounded pieces to buckets all over the range."""
    from docloom.llm.substring_dedup import TOLD_ENTRIES, _send_minimizers, _send_windows

    passage = " ".join(f"w{i}" for i in range(200))
    rows = [(i, passage) for i in range(80)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(16, "id").selectExpr("*", "id AS key", "CAST('' AS BINARY) AS marks")
    columns = "route int, kind int, c0 binary, c1 binary"
    told = docs.mapInArrow(lambda it: _send_minimizers(it, 64, 13, 6), columns).where("kind = 2").collect()
    assert len({r.route for r in told}) >= 8
    every = np.unique(_least(passage)).tobytes()
    marked = docs.select("key", "text", F.lit(every).alias("marks"))
    told = marked.mapInArrow(lambda it: _send_windows(it, 64, 13, 6), columns + ", c2 binary, c3 binary").where("kind = 1").collect()
    assert len({r.route for r in told}) >= 8
    # One task alone: its pieces are bounded and lie apart.
    alone = pa.record_batch({"id": pa.array(range(2000), pa.int64()), "text": [passage] * 2000})
    told = [b for b in _send_minimizers(iter([alone]), 64, 13, 6) if b.column("kind")[0].as_py() == 2]
    routes = [r for b in told for r in b.column("route").to_pylist()]
    sizes = [len(x) // 8 for b in told for x in b.column("c0").to_pylist()]
    assert sum(sizes) == 2000 * len(np.unique(_least(passage))) and max(sizes) <= TOLD_ENTRIES and len(set(routes)) > 1


def _least(text):
    from docloom.llm.substring_dedup import _least_kmers

    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
    return _least_kmers(span_hashes(buf, starts, ends), 13, 6)


def test_binary_columns_are_split_before_their_offsets_overflow():
    from docloom.llm.packing import ragged_binary

    got = ragged_binary(np.arange(10), np.array([0, 1, 1, 3, 6, 10]), most=40)
    assert got.num_chunks > 1 and got.to_pylist() == [np.arange(a, b).tobytes() for a, b in ((0, 1), (1, 1), (1, 3), (3, 6), (6, 10))]
    with pytest.raises(OverflowError):
        ragged_binary(np.arange(10), np.array([0, 10]), most=40)


def _templated(rng, count):
    """Pages of which half is one template and half their own; every hundredth has a near copy."""
    template = [f"t{k}" for k in range(60)]
    rows = []
    for i in range(count):
        own = [f"w{rng.randrange(10**7)}" for _ in range(60)]
        rows.append((i, " ".join(template + own)))
        if i % 100 == 0:
            rows.append((10**6 + i, " ".join([*template, *own[:-1], "changed"])))
    return rows


def test_templated_pages_without_a_partner_meet_no_other(spark):
    from docloom.llm.near_dedup import with_partners
    from docloom.llm.workspace import Workspace

    for count in (500, 2000):
        texts = spark.createDataFrame(_templated(random.Random(3), count), "id long, text string").repartition(4)
        live = {r.id for r in with_partners(texts.selectExpr("id", "id AS label", "true AS asks"), texts, Workspace(spark, "rare"), 80).collect()}
        near = {k for i in range(0, count, 100) for k in (i, 10**6 + i)}
        assert near <= live and len(live) <= 2 * len(near)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(_templated(random.Random(3), 500), "doc_id long, text string")).collect()}
    assert {k for k, c in got.items() if k != c} == {10**6 + i for i in range(0, 500, 100)}
    assert all(got[10**6 + i] == i for i in range(0, 500, 100))


def test_rare_shingles_lose_no_similar_pair(spark):
    """Both of every pair at or over the similarity have a partner, whatever is common; two rows of one label need none."""
    from docloom.llm.near_dedup import with_partners
    from docloom.llm.workspace import Workspace

    rng = random.Random(9)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 60))] for _ in range(40)]
    rows = []
    for w in base:
        for _ in range(6):
            x = w[:]
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = "z"
            rows.append((len(rows), " ".join(x)))
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    sets = [{tuple(t.split(" ")[k : k + 5]) for k in range(max(1, len(t.split(" ")) - 4))} for _, t in rows]
    for percent, label in ((80, "id"), (85, "id"), (85, "id % 2")):
        live = {r.id for r in with_partners(texts.selectExpr("id", f"{label} AS label", "id % 3 = 0 AS asks"), texts, Workspace(spark, "rare"), percent).collect()}
        of = (lambda i: i) if label == "id" else (lambda i: i % 2)
        similar = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if of(i) != of(j) and (i % 3 == 0 or j % 3 == 0) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        assert similar and {k for pair in similar for k in pair} <= live
