import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import documents as D
from docloom.sources import packages as P
from docloom.sources import sinks
from docloom.streaming import watch as W

TYPES = '<Types><Default Extension="xml" ContentType="a/xml"/><Override PartName="/ppt/p.xml" ContentType="a/p"/></Types>'
RELS = '<Relationships><Relationship Id="{0}" Type="t/slide" Target="slides/s1.xml"/><Relationship Id="{1}" Type="t/theme" Target="../theme.xml"/></Relationships>'


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def _package(a="rId1", b="rId2", body="<p r:id=\"rId1\"/>", **more):
    return _zip(**{"[Content_Types].xml": TYPES, "ppt/p.xml": body, "ppt/_rels/p.xml.rels": RELS.format(a, b), "ppt/slides/s1.xml": "<s/>", "theme.xml": "<t/>", "docProps/app.xml": str(a), **more})


def _parts(spark, **packages):
    return P.read_parts(spark.createDataFrame(list(packages.items()), "package string, content binary"))


def test_ids_and_order_of_relationships_say_nothing(spark):
    same = _parts(spark, base=_package(), edited=_package("rId7", "rId1", '<p r:id="rId7"/>'))
    assert P.compare_packages(same, "base", "edited").count() == 0
    other = _parts(spark, base=_package(), edited=_package(body='<p r:id="rId2"/>', extra="x"))
    assert {(r["name"], r["state"]) for r in P.compare_packages(other, "base", "edited").collect()} == {("ppt/p.xml", "changed"), ("extra", "new")}


def test_changed_relationships_are_told_by_their_own_part_and_repeated_ids_too(spark):
    other = RELS.replace('Target="', 'Target="x').format("rId1", "rId1")
    found = _parts(spark, base=_package(), edited=_package(**{"ppt/_rels/p.xml.rels": other}))
    assert {(r["name"], r["state"]) for r in P.compare_packages(found, "base", "edited").collect()} == {("ppt/_rels/p.xml.rels", "changed"), ("ppt/p.xml", "changed")}


def test_states_of_parts_are_told_where_their_decks_were_put_together(spark):
    from docloom import plans
    from docloom.operators import deck
    from tests.oracle import SF

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    decks = plan(deck.compile_decks(plans.package_queries._objects(spark, SF).drop("k")))
    assert plan(plans.QUERIES["r2_r6_part_states"](spark, SF)).count("Exchange") == decks.count("Exchange")


def test_graph_findings(spark):
    bad = _package(**{"ppt/P.xml": "<x/>"})
    missing = _zip(**{"ppt/p.xml": "<p/>", "ppt/_rels/p.xml.rels": RELS.format("r1", "r1")})
    codes = {(r.package, r.code) for r in P.graph_findings(_parts(spark, bad=bad, missing=missing, junk=bytearray(b"no zip"), up=_zip(**{"../x": "y"}))).collect()}
    assert codes == {("bad", "NAME-COLLISION"), ("missing", "MISSING-TARGET"), ("missing", "REPEATED-RELATIONSHIP"), ("junk", "NOT-A-PACKAGE"), ("up", "UNSAFE-NAME")}


def test_written_packages_are_the_same_every_time(spark):
    parts = _parts(spark, a=_package())
    one, two = (bytes(P.write_packages(p).first().content) for p in (parts, parts.repartition(3)))
    assert one == two and zipfile.ZipFile(io.BytesIO(one)).namelist() == sorted(zipfile.ZipFile(io.BytesIO(one)).namelist())


def test_archives_in_pieces_are_the_same_bytes_and_are_read_again(spark):
    rows = [(p, f"{n:03}é.xml" if n % 7 == 0 else f"{n:03}.xml", bytes([n]) * (n * 5000)) for p in ("a", "b") for n in range(80)] + [("c", "one", b"")]
    parts = spark.createDataFrame(rows, "package string, name string, content binary").repartition(5)
    pieces = P.write_pieces(parts).cache()
    found = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.package, r.at)):
        whole = found.setdefault(r.package, bytearray())
        assert r.at == len(whole) and len(r.content) < P.BATCH_BYTES + 500_000
        whole += r.content
    assert found == {r.package: r.content for r in P.write_packages(parts).collect()}
    assert sorted((r.package, r["name"], r.size, r.problem) for r in P.read_pieces(pieces).collect()) == sorted((p, n, len(c), None) for p, n, c in rows)
    assert zipfile.ZipFile(io.BytesIO(found["a"])).testzip() is None
    spoilt = pieces.withColumn("content", F.when((F.col("package") == "a") & (F.col("at") == 0), F.expr("overlay(content PLACING X'FF' FROM length(content))")).otherwise(F.col("content")))
    assert {(r.package, r.problem) for r in P.read_pieces(spoilt).where("problem IS NOT NULL").collect()} == {("a", "BROKEN")}


def test_large_directories_end_as_the_library_ends_them(spark):
    rows = spark.range(65_600).selectExpr("'p' AS package", "lpad(id, 6, '0') AS name", "CAST('' AS BINARY) AS content")
    whole = b"".join(bytes(r.content) for r in sorted(P.write_pieces(rows).collect(), key=lambda r: r.at))
    assert whole == P.write_packages(rows).first().content
    far = P._central([type("E", (), {"name": "n", "crc": 1, "size": 2, "record": 40})], 5 << 30)
    end = P._end(1, len(far), 6 << 30)
    assert struct.unpack_from("<HHQ", far, 47) == (1, 8, 5 << 30) and len(end) == 98


def test_materialise_refuses_bad_bytes(spark):
    rows = spark.createDataFrame([("ok", bytearray("é😀".encode())), ("bad", bytearray(b"\xff\xfe"))], "name string, content binary")
    got = {r["name"]: (r.byte_len, r.char_len, r.utf16_len, r.diagnostic) for r in D.materialise(rows).collect()}
    assert got == {"ok": (6, 2, 3, None), "bad": (2, None, None, "SOURCE-NOT-UTF8")}


def test_sniffing(spark):
    texts = ["﻿<!-- a --><!DOCTYPE html><p>", "<?xml version='1.0'?><svg xmlns='x'/>", ' {"a":1}', "plain"]
    assert [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.sniff_kind("t").alias("k")).collect()] == ["html", "svg", "manifest", "unknown"]


def test_names_are_emitted_once_and_seeds_never(spark, tmp_path):
    src, ckpt = tmp_path / "in", str(tmp_path / "ckpt")
    src.mkdir()
    (src / "a.md").write_text("old")
    seed = spark.createDataFrame([("a.md",)], "name string")
    seen = []

    def run():
        q = W.watch(spark, str(src), seed).writeStream.option("checkpointLocation", ckpt).foreachBatch(lambda df, _: seen.extend(r["name"] for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()

    (src / "b.md").write_text("new")
    run()
    (src / "b.md").unlink()
    run()
    (src / "b.md").write_text("again")
    (src / "c.md").write_text("more")
    run()
    assert sorted(seen) == ["b.md", "c.md"]


def test_quiescence(spark, tmp_path):
    src = str(tmp_path / "obs")
    spark.createDataFrame([("f", i, p) for i, p in enumerate("aabbbbc")] + [("g", 0, "x")], "name string, seq long, fingerprint string").coalesce(1).write.parquet(src)
    out = []
    q = W.quiescent(spark.readStream.schema("name string, seq long, fingerprint string").parquet(src)).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert out == [("f", 4)]


def test_publishing_is_all_or_nothing(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(3)
    sinks.publish_together(spark, {a: df})
    with pytest.raises(FileExistsError):
        sinks.publish_together(spark, {a: df, b: df})
    assert not (tmp_path / "b").exists()
    sinks.publish_together(spark, {a: spark.range(5), b: df}, replace=True)
    assert spark.read.parquet(a).count() == 5 and spark.read.parquet(b).count() == 3
