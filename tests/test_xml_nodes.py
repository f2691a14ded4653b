"""XML parts read where they are, and packages of one content read once."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import packages as P
from docloom.sources import xml_tree as T

ODD = [
    "", "plain", "﻿<a/>", "<a><b x='1' y=\"2&lt;&#65;&#x42;\"/>t&amp;u<![CDATA[<z>]]>v</a>", "<a></a></a><b/>x</b>", "<a><b></a>t</b>u", "<x:a xmlns:x='u' xmlns='d'><x:b x:k='1' k='2'/><c xmlns='' x:q='1'><d/></c><y:e/></x:a>",
    "<a b='1' b='2' c='3'/>", "<a xmlns:p='u' xmlns:q='u' p:k='1' q:k='2'/>", "<!-- <a> --><?pi <b>?><!DOCTYPE a><a><</a>", "<a>\n<b xml:lang='e'>q</b>r<b/>s</a>", "<:a/><_b c = '&quot;'>é\U0001f600</_b>", "</z><a><b/></a>",
    "<a ><b\n/></a >", "<x:n xmlns:x='a'><x:n xmlns:x='b'><t>&amp;lt;</t></x:n><x:k/></x:n>", None,
]


def _rows(df, *columns):
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def test_parts_read_in_place_give_the_rows_of_their_tokens(spark):
    parts = spark.createDataFrame([(f"p{k}", "n.xml", t) for k, t in enumerate(ODD)], "package string, name string, t string")
    plain = T.elements(T.tokens(parts, text=F.col("t")))
    read = T.read_elements(parts, text=F.col("t"))
    assert read.dtypes == plain.dtypes
    assert _rows(read, *read.columns) == _rows(plain, *plain.columns)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    tags = ("b", "{u}b")
    held = T.held_by(T.read_elements(parts, text=F.col("t"), anchors={"k": tags}), "k")
    columns = ("package", "node", "anchor", "anchor_tag", "below")
    assert _rows(held, *columns) == _rows(T.anchored(plain, F.col("tag").isin(*tags)), *columns)


def test_faults_read_in_place_are_those_of_their_tokens(spark):
    more = [
        '<?xml version="1.1"?><a/>', '<?xml version="1.0"?><a/>', "<a/><?xml version='1.0'?>", "<?XML?><a/>", "<!-- a -\n--><a/>", "<!-- a ---><a/>", "<!-- a -- b --><a/>", "<a>]]></a>", "<a>&nbsp;</a>", "<a b='&x;'/>", "<a b/>", "<a b='1'c='2'/>",
        "<a></b></a>", "<a><b></a></b>", "<x:a/>", "<a x:b='1'/>", "<x:a xmlns:x=''/>", "<a xmlns:x='u'><x:b/></a>", "<a xmlns:x='u'/><x:b/>", "<a xmlns:x='u'><x:b>", "<xml:a/>", "<a\x01/>", "<a>\uffff</a>", "<![CDATA[x]]><a/>", "<a/>x", " <a/>\n", "<a/ >", "<1/>", "<a", "<!DOCTYPE a><x:a/>", "<?1 x?><a/>", "<a\u00a0b='1'/>", "</a>",
    ]
    parts = spark.createDataFrame([(f"p{k}", "n.xml", t) for k, t in enumerate([*ODD, *more])], "package string, name string, t string")
    read = T.read_faults(parts, text=F.col("t"))
    plain = T.faults(T.tokens(parts, text=F.col("t")))
    assert read.dtypes == plain.dtypes
    assert _rows(read, *read.columns) == _rows(plain, *plain.columns)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert [T._fault_codes(t) for t in ("<!-- a -\n--><a/>", "<!-- a ---><a/>", "<x:a/>")] == [[], ["XML-MALFORMED"], ["XML-NAMESPACE"]]


def test_packages_of_one_content_are_used_once(spark):
    parts = spark.createDataFrame(
        [("a", "x", b"1"), ("a", "y", b"2"), ("b", "y", b"2"), ("b", "x", b"1"), ("c", "x", b"2"), ("c", "y", b"1"), ("d", "x", b"1"), ("e", "x", None), ("f", "x", b""), ("g", "x", b"1"), ("g", "x", b"1")],
        "package string, name string, content binary",
    )
    used = []

    def use(given):
        used.extend(sorted({r.package for r in given.collect()}))
        return given.groupBy("package").agg(F.count("*").alias("n"))

    got = {(r.package, r.n) for r in P.once_per_content(parts, use).collect()}
    assert used == ["a", "c", "d", "e", "f", "g"]
    assert got == {("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1), ("f", 1), ("g", 2)}


@pytest.mark.parametrize("name", ["p13_c34_w13_style_inheritance", "n4_n11_normalisation_proofs", "n4_n11_a14_normalisation_evidence", "r13_style_drift"])
def test_equal_packages_are_shredded_once(spark, monkeypatch, name):
    from docloom import plans
    from tests.oracle import SF

    seen = []
    read = T.read_elements
    monkeypatch.setattr(T, "read_elements", lambda parts, *a, **k: seen.append(parts.select("package").distinct().count()) or read(parts, *a, **k))
    plans.QUERIES[name](spark, SF)
    assert max(seen) <= 40


def test_targets_are_resolved_without_a_shuffle(spark):
    from docloom import plans
    from tests.oracle import SF

    found = plans.QUERIES["c28_n2_resolved_targets"](spark, SF)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_archives_leave_a_task_together_and_in_order():
    import pandas as pd

    packed = [P._pack((f"p{k}",), pd.DataFrame({"name": ["a", "b"], "content": [b"1", bytes(k)]})) for k in range(40)]
    given = pd.concat([*packed, pd.DataFrame({"package": ["broken"], "content": [b"no"]})])
    frames = list(P._unpack(iter([given[:7], given[7:]])))
    assert len(frames) == 1 and len(frames[0]) == 81
    assert list(frames[0]["package"])[::2] == [*(f"p{k}" for k in range(40)), "broken"]
    assert list(frames[0]["problem"])[-1] == "NOT-A-PACKAGE"
    large = pd.concat([P._pack((f"q{k}",), pd.DataFrame({"name": ["a"], "content": [bytes(P.BATCH_BYTES + 1)]})) for k in range(3)])
    assert [len(f) for f in P._unpack(iter([large]))] == [1, 1, 1]


def test_packages_are_archived_from_a_stream_whatever_its_batches():
    import pandas as pd

    rows = pd.DataFrame([(f"p{k}", n, bytes([k])) for k in range(5) for n in "cab"], columns=["package", "name", "content"])
    whole = pd.concat([P._pack((k,), g) for k, g in rows.groupby("package")])
    for size in (1, 2, 3, 4, 7, 15):
        batches = [rows[:0], *(rows[i : i + size] for i in range(0, len(rows), size))]
        got = pd.concat(P._packed(iter(batches)))
        assert list(got["package"]) == list(whole["package"]) and list(got["content"]) == list(whole["content"])
    assert list(P._packed(iter([rows[:0]]))) == []
