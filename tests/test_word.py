from pyspark.sql import functions as F

from docloom.operators import markdown as M
from docloom.operators import word as W
from docloom.sources import packages as P
from tests.test_markdown import SAMPLE

PLAIN = "# A & B\n\nText with **bold**, *italic* and `code <x>`.\n\n1. one\n2. two\n\n- item\n"


def _docs(spark):
    return spark.createDataFrame([(1, SAMPLE), (2, PLAIN), (3, "")], "doc_id long, text string")


def test_round_trip_through_packages(spark):
    files = P.write_packages(W.to_parts(_docs(spark))).cache()
    parts = P.read_parts(files)
    assert P.graph_findings(parts).count() == 0 and W.refusals(parts).count() == 0
    got = {r.package: r for r in W.inverted(parts).collect()}
    want = {str(r.doc_id): r.markdown for r in M.canonical(_docs(spark)).collect()}
    for package in ("1", "2"):
        assert got[package].markdown == want[package] and got[package].proven
    assert {r.package: (r.original, r.problem) for r in W.embedded_source(parts).collect()}["2"] == (PLAIN, None)


def test_changed_sources_and_lost_constructs_are_told(spark):
    parts = W.to_parts(_docs(spark)).withColumn("content", F.when(F.col("name") == W.SOURCE, F.encode(F.regexp_replace(F.decode("content", "UTF-8"), 'sha256="[0-9a-f]', 'sha256="0'), "UTF-8")).otherwise(F.col("content")))
    parts = parts.withColumn("content", F.when(F.col("name") == W.BODY, F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("<w:body>"), F.lit('<w:body><w:ins w:id="1"/>')), "UTF-8")).otherwise(F.col("content")))
    assert {r.problem for r in W.embedded_source(parts).collect()} <= {"SOURCE-CHANGED", None} and W.embedded_source(parts).where("problem = 'SOURCE-CHANGED'").count() >= 2
    assert {r.code for r in W.refusals(parts).collect()} == {"REVISION"}
    assert W.embedded_source(parts.where(F.col("name") != W.SOURCE)).where("problem = 'SOURCE-MISSING'").count() == 3


def test_archives_are_looked_at_once_for_their_sources(spark):
    from docloom import plans
    from tests.oracle import SF

    plan = plans.QUERIES["k6_k7_s20_s22_embedded_sources"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_unpack") == 1
