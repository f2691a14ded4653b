import datetime as dt

from docloom.operators import repository as R
from docloom.sources import packages as P


def _files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_md", ".md"), v) for k, v in texts.items()], "path string, text string")


def test_references_and_links(spark):
    files = _files(spark, docs__a_md="see CONTRACT:C1-X.1.0 and [b](b.md#top) [up](../src) [no](gone.md) [w](https://x.y)", docs__b_md="CONTRACT:C2-Y\n", src__c_md="x")
    lines = R.file_lines(files)
    found = R.references(lines)
    assert {(r.path, r["name"]) for r in found.collect()} == {("docs/a.md", "C1-X.1.0"), ("docs/b.md", "C2-Y")}
    known = spark.createDataFrame([("C2-Y",), ("C3-Z",)], "name string")
    assert [r["name"] for r in R.broken_references(found, known).collect()] == ["C1-X.1.0"]
    assert {(r["name"], r.state) for r in R.zombies_and_shadows(known, found).collect()} == {("C3-Z", "zombie"), ("C1-X.1.0", "shadow")}
    assert [r.target for r in R.link_targets(lines, files).collect()] == ["docs/gone.md"]


def test_sections_versions_and_markers(spark):
    files = _files(spark, a_md="## Interfaces\nx\n\n<!-- c -->\n## Behavioral\n## Error\n## Test\ny\nz\n## Implementing\n", b_md="HEAD\n## Test\nTODO(#4) a\nTODO b")
    lines = R.file_lines(files)
    assert {r.path: (r.n_sections, r.complete) for r in R.section_completeness(lines).collect()} == {"a.md": (5, True), "b.md": (1, False)}
    assert {r.heading: r.n_content for r in R.content_by_section(lines).where("path = 'a.md'").collect()} == {"## Interfaces": 1, "## Behavioral": 0, "## Error": 0, "## Test": 2, "## Implementing": 0}
    assert [r.path for r in R.missing_headers(lines, "HEAD").collect()] == ["a.md"]
    assert tuple(R.todo_counts(lines).first()) == (2, 1, 1)
    names = spark.createDataFrame([("A-1.1.9.md",), ("A-1.1.10.md",), ("B-2.0.1.md",), ("junk",)], "name string")
    assert {(r.id, r["name"]) for r in R.latest_versions(names).collect()} == {("A-1", "A-1.1.10.md"), ("B-2", "B-2.0.1.md")}
    dated = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 3, 1))], "path string, last_verified date")
    assert [r.path for r in R.stale(dated, dt.date(2024, 4, 1), 60).collect()] == ["a"]


def test_shapes_in_painters_order(spark):
    rows = [("s", "b", "rect", 2, 1.0, 1.0, 2.0, 2.0), ("s", "a", "ellipse", 1, 0.0, 0.0, 1.0, 1.0)]
    xml = P.render_shapes(spark.createDataFrame(rows, "scope_id string, id string, kind string, z int, x double, y double, width double, height double")).first().xml
    assert xml.index('name="a"') < xml.index('name="b"') and 'x="7620"' in xml and 'prst="ellipse"' in xml
