import pytest
from pyspark.sql import functions as F

from docloom.functions.scalars import splice
from docloom.operators import evidence as V
from docloom.operators import objects as O
from docloom.operators import ranges as R
from docloom.sources.shared_tables import SharedTables


def _docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_style_sheets_awkward_and_broken(spark):
    sheets = _docs(
        spark, fine="a{b:c}", empty="", none=None, last="a { b: c; d : 'e;\\'}' }", open="a { b: c; ", closed="a { b: c } }", nested="@supports (x: y) { @media z { p { q: r } } s { t: u } }",
        font="@font-face { src: url(x) } @import 'x'; a:b { c:d }", bracket="a[b=']'] { c: (;) }",
    )
    found, faults = R.css_rules(sheets)
    got = {(r.doc_id, r.selector, r.property, r.value) for r in found.collect()}
    assert {g for g in got if g[0] == "fine"} == {("fine", "a", "b", "c")}
    assert {g[2:] for g in got if g[0] == "last"} == {("b", "c"), ("d", "'e;\\'}'")}
    assert {g[1:] for g in got if g[0] == "font"} == {("@font-face", "src", "url(x)"), ("a:b", "c", "d")}
    assert {g[1:] for g in got if g[0] == "bracket"} == {("a[b=']']", "c", "(;)")}
    assert ("nested", "s", "t", "u") in got
    assert {(r.doc_id, r.code) for r in faults.collect()} == {("open", "UNCLOSED"), ("closed", "UNOPENED")}


def test_ranges_of_declarations_cut_the_source(spark):
    text = "/* c */ a {\n  b : c ; /* x */ d: e\n}"
    found, _ = R.css_rules(_docs(spark, d=text))
    assert [text[r.start : r.end] for r in found.orderBy("ordinal").collect()] == ["b : c", "d: e"]


def test_json_ranges_of_empty_and_deep_texts(spark):
    text = '{"a": {"b": [1, {"c": "x,:{\\"}"}], "": null}, "d": []}'
    values = R.with_paths(R.json_fields(_docs(spark, d=text, e="", f=None, g="7")))
    got = {(r.doc_id, r.path): (r.kind, text[r.start : r.end] if r.doc_id == "d" else r.raw, r["shape"]) for r in values.collect()}
    assert got["d", "/a/b/1/c"] == ("string", '"x,:{\\"}"', "/a/b/*/c") and got["d", "/a/b"][1] == '[1, {"c": "x,:{\\"}"}]'
    assert got["d", "/a/"][0] == "null" and got["d", "/d"][:2] == ("array", "[]") and got["d", ""][1] == text
    assert got["g", ""] == ("number", "7", "") and {k[0] for k in got} == {"d", "g"}
    with pytest.raises(ValueError, match="nested"):
        R.with_paths(R.json_fields(_docs(spark, d="[" * 9 + "]" * 9)), most=4)


def test_schemas_name_what_they_do_not_know(spark):
    with pytest.raises(ValueError, match="anyOf"):
        V.schema_rows({"properties": {"a": {"anyOf": []}}})
    values = R.with_paths(R.json_fields(_docs(spark, d='{"a": "x"}')))
    assert V.violations(values, V.constraints(spark, {"type": "object"})).count() == 0


def test_closure_by_doubling(spark):
    edges = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(300)] + [("x", "elsewhere"), ("y", "c10")]
    got = {(r.id, r.ancestor_id): r.distance for r in O.ancestor_closure(spark.createDataFrame(edges, "id string, parent_id string")).collect()}
    assert got == {(f"c{k}", f"c{j}"): k - j for k in range(300) for j in range(k)} | {("y", f"c{j}"): 11 - j for j in range(11)}
    for ring in ([("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]):
        with pytest.raises(ValueError, match="ancestor of itself"):
            O.ancestor_closure(spark.createDataFrame(ring, "id string, parent_id string"))


def test_hashed_trees_name_the_top_of_what_differs(spark):
    schema = "scope_id string, id string, parent_id string, depth int, sibling_order int, text string"
    rows = [("s", "r", None, 0, 0, "r"), ("s", "a", "r", 1, 0, "a"), ("s", "b", "r", 1, 1, "b"), ("s", "a1", "a", 2, 0, "1"), ("s", "b1", "b", 2, 0, "1")]
    hashed = lambda rows: V.subtree_hashes(spark.createDataFrame(rows, schema), V.F.col("text"))
    same = [(*r[:5], "other") if r[1] == "b1" else r for r in rows if r[1] not in ("a", "a1")] + [("s", "n", "r", 1, 2, "n"), ("s", "n1", "n", 2, 0, "n")]
    assert {tuple(r) for r in V.differing_subtrees(hashed(rows), hashed(same)).collect()} == {("a", "removed"), ("n", "added"), ("b1", "changed")}
    assert V.differing_subtrees(hashed(rows), hashed(rows)).count() == 0
    assert V.differing_subtrees(hashed([]), hashed(rows)).collect()[0].id == "r"


def test_splice_counts_places_in_the_given_text(spark):
    rows = [("", "XYY"), ("ab", "XYY"), ("abcdefghijklmnop", "XdefghiYYmnop"), (None, None)]
    edits = "array(named_struct('start', 9, 'end', 12, 'replacement', 'YY'), named_struct('start', 0, 'end', 3, 'replacement', 'X'))"
    got = spark.createDataFrame(rows, "text string, want string").select("want", splice("text", F.expr(edits)).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_chain_tops_write_a_row_an_object_and_name_a_cycle(spark, monkeypatch):
    written = []
    cut = SharedTables.cut
    monkeypatch.setattr(SharedTables, "cut", lambda self, name, df: (lambda t: written.append(t.count()) or t)(cut(self, name, df)))
    chain = spark.range(1, 301).selectExpr("id", "CASE WHEN id > 1 THEN id - 1 ELSE -7 END AS parent_id")
    assert {(r.id, r.top, r.distance) for r in O.chain_tops(chain).collect()} == {(k, 1, k - 1) for k in range(2, 301)}
    assert max(written) == 299
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]
    with pytest.raises(ValueError, match="^[abc] is an ancestor of itself"):
        O.chain_tops(spark.createDataFrame(ring, "id string, parent_id string"))


def test_json_read_in_place_gives_the_rows_of_its_tokens(spark):
    texts = [
        '{"a": [1, {"b": "x,}\\""}, []], "c" : true}', "", "[]", '"s"', "{", '{"a": 1', "[1, 2", '{"a": {"b": [null, [0]]}, "a": 2}', '[{"k": 1}, {"k": 2}] {"z": 3}', '{"a" 1}', '{:1, "b": }', "{} }", '{"é": "\\u00e9 😀", "n":-1.5e3}', "]{\"a\": 1}", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = R.with_paths(R.json_fields(docs))
    read = R.read_json(docs)
    assert read.drop("holder", "names").dtypes == plain.dtypes
    rows = lambda df: sorted(repr([r[c] for c in plain.columns]) for r in df.collect())
    assert rows(read) == rows(plain)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    schema = {"type": "object", "additionalProperties": False, "required": ["c", "q"], "properties": {"a": {"type": "array", "minItems": 4, "items": {"type": "integer"}}, "c": {}}}
    rules = V.constraints(spark, schema)
    told = lambda df: sorted(map(tuple, V.violations(df, rules).collect()), key=repr)
    assert told(read) == told(plain)
    assert [r[1:] for r in told(read) if r[0] == 0] == [("", "required", "q"), ("/a", "minItems", "4"), ("/a/1", "type", "integer"), ("/a/2", "type", "integer")]


def test_style_sheets_are_read_without_a_shuffle(spark):
    from docloom import plans
    from tests.oracle import SF

    found = plans.QUERIES["c12_style_rules"](spark, SF)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_families_are_migrated_without_a_shuffle(spark):
    from docloom import plans
    from tests.oracle import SF

    found = plans.QUERIES["m15_o4_migrated_families"](spark, SF)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_families_are_renamed_after_a_byte_order_mark_and_in_values_without_quotes(spark):
    texts = {"bom": "\ufeff<a data-old-x='1'/>", "bare": "<a style=--old-b:1 />", "none": None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = {r.doc_id: (r.text, r.n_edits, r.proven) for r in R.migrate(docs, "old", "next").collect()}
    assert found == {"bom": ("\ufeff<a data-next-x='1'/>", 1, True), "bare": ("<a style=--next-b:1 />", 1, True), "none": (None, 0, True)}
