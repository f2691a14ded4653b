import pytest
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import styles as Y


@pytest.mark.parametrize(("anchor", "x", "room"), [("start", 175, 425), ("end", 525, 425), ("middle", 250, 300), ("middle", 350, 500)])
def test_room_depends_on_the_anchor(spark, anchor, x, room):
    row = spark.createDataFrame([(anchor, float(x), 100.0, 500.0)], "a string, x double, fx double, fw double")
    assert row.select(S.available_width("a", "x", "fx", "fw").alias("w")).first().w == room


@pytest.mark.parametrize(("width", "room", "status", "used"), [(100.0, 1360.0, "clear", 100 / 1360), (1215.0, 1350.0, "near-limit", 0.9), (1401.0, 1400.0, "overflow", 1401 / 1400), (None, 5.0, "unverified", None), (0.0, 0.0, "clear", 0.0), (1.0, 0.0, "overflow", None)])
def test_fit(spark, width, room, status, used):
    row = spark.createDataFrame([(width, room)], "w double, a double").select(S.fit_status("w", "a").alias("s"), S.utilisation("w", "a").alias("u")).first()
    assert row.s == status and (row.u is None if used is None else row.u == pytest.approx(used))


def test_cascade_precedence(spark):
    nodes = spark.createDataFrame([("t", ["title"], {"fill": "#abcdef", "font-size": "20", "stroke-width": "2"}, {"fill": "#112233", "opacity": "0.5"})], "id string, classes array<string>, attributes map<string,string>, inline map<string,string>")
    rules = spark.createDataFrame([("title", 0, "font-size", "96", None), ("title", 1, "fill", None, "ink"), ("title", 7, "font-size", "88", None)], "class string, source_order int, property string, literal string, token string")
    theme = spark.createDataFrame([("ink", "#000001")], "token string, expression string")
    got = {r.property: (r.value, r.origin) for r in Y.cascade(nodes, rules, theme).collect()}
    assert got["fill"] == ("#112233", "inline-style")
    assert got["font-size"] == ("88", "base-rule")
    assert got["stroke-width"] == ("2", "presentation-attribute")
    assert got["opacity"] == ("0.5", "inline-style")
    assert got["font-weight"] == ("400", "default")


def test_offsets_and_bounds(spark):
    nodes = spark.createDataFrame([("G", [], 100.0, 40.0), ("I", ["G"], -5.0, 10.0), ("r", ["G", "I"], 0.0, 0.0)], "id string, ancestor_ids array<string>, tx double, ty double")
    assert {(r.id, r.world_x, r.world_y) for r in Y.world_offsets(nodes).collect()} == {("G", 100.0, 40.0), ("I", 95.0, 50.0), ("r", 95.0, 50.0)}
    leaves = spark.createDataFrame([(["G"], 10.0, 20.0, 20.0, 20.0), (["G"], 45.0, 15.0, 10.0, 30.0), (["G"], -20.0, 0.0, 10.0, 10.0), (["G", "I"], -5.0, 10.0, 10.0, 20.0)], "ancestor_ids array<string>, x double, y double, width double, height double")
    got = {r.id: (r.x, r.y, r.width, r.height) for r in Y.group_bounds(leaves).collect()}
    assert got["G"] == (-20.0, 0.0, 75.0, 45.0)


def test_hashes_and_units(spark):
    row = spark.createDataFrame([("abc", "", "añ😀")], "a string, e string, u string").select(S.fnv1a32("a").alias("a"), S.fnv1a32("e").alias("e"), S.utf16_length("u").alias("u"), S.to_emu(F.lit(0.25)).alias("ok"), S.to_emu(F.lit(0.00001)).alias("no")).first()
    assert (row.a, row.e, row.u, row.ok, row.no) == (440920331, 2166136261, 4, 1905, None)


def test_a_failing_measurer_gives_unverified_lines(spark):
    lines = spark.createDataFrame([("ab",), ("abcd",)], "text string")

    def broken(texts):
        raise ValueError("no font")

    assert [r.width for r in Y.measured(lines, broken).collect()] == [None, None]
    assert sorted(r.width for r in Y.measured(lines, lambda t: t.str.len() * 2.0).collect()) == [4.0, 8.0]


def test_strict_values(spark):
    texts = ["12", "-.5e1", "1px", "", "+3.", "-0"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.strict_number("t").alias("n")).collect()]
    assert got == [12.0, -5.0, None, None, 3.0, 0.0]


GOOD_VALUES = [("fill", " NONE ", "none"), ("stroke", "#AbC123", "#abc123"), ("stroke-width", "2PX", 2.0), ("stroke-width", "-0", 0.0), ("font-size", "1e1", 10.0), ("opacity", ".5", 0.5), ("font-family", "Noto  Sans", "Noto Sans"), ("font-family", "'A, B'", "A, B"), ("font-weight", "700", 700.0), ("font-style", "Italic", "italic"), ("text-anchor", "end", "end")]
BAD_VALUES = [
    ("fill", "#abc", "VALUE"), ("fill", "red", "VALUE"), ("fill", "var(--x)", "VALUE"), ("fill", "", "VALUE"), ("fill", None, "VALUE"), ("fill", "none !important", "VALUE"), ("stroke-width", "-1", "VALUE"), ("stroke-width", "1em", "VALUE"), ("font-size", "0", "VALUE"),
    ("font-size", "1e999", "VALUE"), ("opacity", "1.1", "VALUE"), ("opacity", "1px", "VALUE"), ("font-family", "a, b", "FONT"), ("font-family", "Serif", "FONT"), ("font-family", "'serif'", "FONT"), ("font-family", "'it's'", "FONT"), ("font-family", "unset", "VALUE"), ("font-weight", "bold", "FONT"),
    ("font-style", "oblique", "FONT"), ("text-anchor", "left", "VALUE"), ("margin", "1", "UNKNOWN"), (None, "1", "UNKNOWN"),
]


def test_style_values_by_property(spark):
    rows = spark.createDataFrame([(p, g, str(w)) for p, g, w in GOOD_VALUES + BAD_VALUES], "p string, g string, w string").select("p", "g", "w", Y.style_value("p", "g").alias("v")).collect()
    for r in rows[: len(GOOD_VALUES)]:
        assert r.v.code is None and r.w == str(r.v.text if r.v.text is not None else r.v.number), r
    for r in rows[len(GOOD_VALUES) :]:
        assert (r.v.code, r.v.text, r.v.number) == (r.w, None, None), r


def test_a_cascade_meets_once_and_its_text_where_it_is(spark):
    from docloom import plans
    from tests.oracle import SF

    plan = plans.QUERIES["c35_style_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1
