from docloom.operators import diff as D
from docloom.operators import edits as E
from docloom.operators import integrity as I
from docloom.operators import objects as O
from docloom.operators import raster as R
from docloom.operators import reconcile as C

NODES = "id string, text string, style string"
OPS = "seq int, op string, id string, old string, new string"


def test_one_refused_operation_withholds_the_log(spark):
    nodes = spark.createDataFrame([("a", "x", "s"), ("b", "y", "s")], NODES)
    good = spark.createDataFrame([(1, "set-text", "a", "x", "X")], OPS)
    stale = spark.createDataFrame([(1, "set-text", "a", "x", "X"), (2, "set-native-style", "b", "old", "n")], OPS)
    after, _ = E.apply_operations(nodes, good)
    assert {(r.id, r.text) for r in after.collect()} == {("a", "X"), ("b", "y")}
    after, checked = E.apply_operations(nodes, stale)
    assert {(r.id, r.text) for r in after.collect()} == {("a", "x"), ("b", "y")}
    assert {r.seq: r.verdict for r in checked.collect()} == {1: "ok", 2: "stale-value"}


def test_undo_redo(spark):
    log = [("s", 1, "set", "a"), ("s", 2, "set", "b"), ("s", 3, "undo", None), ("s", 4, "redo", None), ("s", 5, "undo", None), ("s", 6, "set", "c"), ("s", 7, "redo", None), ("e", 1, "undo", None)]
    got = {r.session: (r.value, r.depth, r.undone) for r in E.fold_sessions(spark.createDataFrame(log, "session string, seq int, action string, value string")).collect()}
    assert got == {"s": ("c", 2, 0), "e": (None, 0, 0)}


def test_diff_treats_nulls_as_equal_and_classifies(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", 5)], "id int, text string, meta int")
    right = spark.createDataFrame([(1, None, 6), (2, "a", 5)], "id int, text string, meta int")
    changes = D.diff_snapshots(left, right, {"text": "text", "meta": "metadata"})
    assert [(r.id, r.kind, r.old_value, r.new_value) for r in changes.collect()] == [(1, "metadata", "5", "6")]
    summary = D.summarize(changes, ["added", "removed", "text", "metadata"])
    assert D.classify(summary, ["metadata"]).first().classification == "semantic-equivalent"
    assert D.classify(summary, ["metadata"], most=0).first().classification == "incomparable"
    assert D.classify(D.summarize(changes.where("false"), ["added", "text", "metadata"]), ["metadata"]).first().classification == "exact"


def test_ambiguous_ids_match_nothing(spark):
    rows = [("s", "a", None, [], 0, 0, "text", "t", ["c"], "One", False), ("s", "b", None, [], 1, 0, "text", "t", ["c"], "Two", False), ("s", "b", None, [], 2, 0, "text", "t", ["c"], "Two", False)]
    nodes = spark.createDataFrame(rows, "scope_id string, id string, parent_id string, ancestor_ids array<string>, sibling_order int, depth int, role string, element string, classes array<string>, text string, hidden boolean")
    assert [r.id for r in O.query_objects(nodes, class_name="c").collect()] == ["a"]
    assert O.get_object(nodes, "b").count() == 0 and O.get_object(nodes, "a").count() == 1


def test_recursive_paths_go_deep(spark):
    n = 150
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)], "id string, parent_id string")
    deepest = O.tree_paths(spark, nodes).selectExpr("max(size(ancestor_ids)) AS d").first().d
    assert deepest == n - 1


def test_topmost_missing_and_hazards(spark):
    mapped = spark.createDataFrame([("g", None), ("k", "g"), ("z", "y")], "id string, parent_id string")
    gone = spark.createDataFrame([("g",), ("k",)], "id string")
    assert [r.id for r in I.topmost_missing(mapped, gone).collect()] == ["g"]
    edges = spark.createDataFrame([("e1", "g", "z"), ("e2", "z", "z"), ("g", "g", "g")], "id string, from_id string, to_id string")
    assert [r.id for r in I.deletion_hazards(edges, gone).collect()] == ["e1"]


def test_image_difference(spark):
    flat = [("i", x, y, 10, 10, 10, 255) for y in range(2) for x in range(3)]
    other = [(i, x, y, *((42, 42, 42) if (x, y) == (1, 1) else (r, g, b)), a) for i, x, y, r, g, b, a in flat]
    schema = "img string, x int, y int, r int, g int, b int, a int"
    a, b = spark.createDataFrame(flat, schema), spark.createDataFrame(other, schema)
    got = R.image_diff(a, b).first()
    assert (got.changed, got.absolute, got.mean_absolute_error, got.max_delta, got.x0, got.y0, got.x1, got.y1) == (1, 96, 4.0, 32, 1, 1, 1, 1)
    assert R.image_diff(a, b, tolerance=32).first().changed == 0
    mask = spark.createDataFrame([("i", 1, 1, 255, 255, 255)], "img string, x int, y int, r int, g int, b int")
    got = R.image_diff(a, b, mask=mask).first()
    assert (got.pixels - got.masked, got.changed) == (5, 0)
    assert R.verdict(R.image_diff(a, b), 0, 0, 0).first().verdict == "failed"


def test_ascii_rasters(spark):
    files = spark.createDataFrame([("p", "P3 # c\n2 1\n255\n1 2 3 4 5 6\n")], "path string, text string")
    assert {(r.x, r.y, r.r, r.g, r.b) for r in R.read_pnm(files).collect()} == {(0, 0, 1, 2, 3), (1, 0, 4, 5, 6)}


def test_status_ladder(spark):
    rows = spark.createDataFrame([("a", "auto-fixable", "source-change"), ("b", "refused", "none")], "id string, disposition string, effect string")
    got = C.status(rows).first()
    assert (got.status, got.highest) == ("refused", "refused")
    assert C.status(rows.where("false")).first().status == "unchanged"


def test_images_of_unequal_size_never_pass(spark):
    rows = [("i", x, y, 10, 10, 10, 255) for y in range(2) for x in range(3)]
    schema = "img string, x int, y int, r int, g int, b int, a int"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:-1], schema)
    for left, right in ((a, b), (b, a)):
        got = R.verdict(R.image_diff(left, right), 1.0, 255.0, 255.0).first()
        assert (got.pixels, got.unmatched, got.changed, got.max_delta, got.verdict) == (6, 1, 1, 255, "failed")
    assert R.verdict(R.image_diff(a, a), 0, 0, 0).first().verdict == "passed"


def test_long_sessions_fold_in_one_pass(spark):
    log = [("s", k, "set", f"v{k}") for k in range(20_000)] + [("s", 20_000 + k, "undo", None) for k in range(15_000)] + [("s", 40_000 + k, "redo", None) for k in range(20)] + [("t", 0, "undo", None)]
    got = {r.session: (r.value, r.depth, r.undone) for r in E.fold_sessions(spark.createDataFrame(log, "session string, seq int, action string, value string")).collect()}
    assert got == {"s": ("v5019", 5020, 14_980), "t": (None, 0, 0)}


def test_reconciling_is_proved_by_applying(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "id long, text string, style string")
    edited = spark.createDataFrame([(1, "a2", "x"), (2, "b", "y"), (4, "d", "w")], "id long, text string, style string")
    fields = {"text": "set-text", "style": "set-native-style"}
    ops, found, verdict = C.reconcile(base, edited, fields, review=("set-native-style",))
    assert {(r.id, r.op, r.new) for r in ops.collect()} == {(1, "set-text", "a2"), (2, "set-native-style", "y")}
    assert {(r.id, r.op, r.disposition) for r in found.collect()} == {(1, "set-text", "auto-fixable"), (2, "set-native-style", "review"), (3, "object-missing", "refused"), (4, "object-new", "refused")}
    assert verdict.first().status == "refused" and C.unproven(base, edited, fields).count() == 0
    assert C.reconcile(base, base, fields)[2].first().status == "unchanged"


def test_refused_measurements_are_null_and_mistakes_are_not_hidden(spark):
    import pytest
    from docloom.operators import styles as Y

    lines = spark.createDataFrame([("abc",), ("bad",), ("de",)], "text string").coalesce(1)

    def refusing(texts):
        if "bad" in set(texts):
            raise ValueError("no glyph")
        return [len(t) * 2.0 for t in texts]

    assert {r.text: r.width for r in Y.measured(lines, refusing).collect()} == {"abc": 6.0, "bad": None, "de": 4.0}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        Y.measured(lines, lambda texts: [1 / 0 for _ in texts]).collect()
