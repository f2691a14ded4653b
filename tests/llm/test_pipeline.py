from pyspark.sql import functions as F

import corpus_pipeline as P
from docloom.llm.personal_data import find_personal_data
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == COLUMNS
    quality = kept["quality_rules"]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, _, _, _, repeat = brute.base_quality(r.text)
        if n < 50 or 100 * repeat > 50 * n:
            assert r.doc_id not in quality
    rows = [(i, r.text) for i, r in quality.items()]
    expected = {i for i, (_, c) in brute.components(rows, 80).items() if i == c}
    assert set(kept["near_dedup"]) == expected
    items = [brute.words(r.text, lower=True) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, r in kept["near_dedup"].items():
        text = " " + " ".join(brute.words(r.text, lower=True)) + " "
        if any(" " + " ".join(x) + " " in text for x in items):
            assert i not in kept["decontamination"]
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    assert find_personal_data(spark.createDataFrame([(i, r.text) for i, r in kept["personal_data"].items()], "doc_id long, text string")).where(F.size("base") > 0).count() == 0
    for i, r in kept["mixing"].items():
        assert 0 < r.taken <= 2 * r.size and r.text == kept["personal_data"][i].text


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "personal_data", "mixing"]
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "taken"} <= set(out.columns)


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    rows = [*brute.awkward_documents(12, 40), (80001, None, None, None, None, 1, "k", "d")]
    spark.createDataFrame(rows, brute.SCHEMA).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() >= 0
