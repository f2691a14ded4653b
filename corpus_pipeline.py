"""A corpus pipeline: quality rules, near-dedup, decontamination, personal data, and mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontamination import drop_leaking
from docloom.llm.mixing import mix_sources
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.personal_data import find_personal_data, redacted
from docloom.llm.quality_rules import quality_rules
from docloom.llm.workspace import Workspace


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, verdicts: DataFrame, condition: str) -> DataFrame:
    """The rows whose id has a verdict that meets the condition; rows with null id stay with none against them."""
    kept = verdicts.where(condition).select("doc_id").distinct()
    return docs.hint("merge").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the base conditions or the weighted rules reject.

    A row without an id is judged by its text, since a verdict depends on the text alone; null, blank and very long
    texts, ties and repeated rows are as ``quality_rules`` defines them; an empty table gives an empty one.
    """
    by_text = F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit(""))))
    named = _documents(docs).withColumn("row_key", F.coalesce(F.col("doc_id").cast("string"), by_text))
    kept = quality_rules(named, id_col="row_key").where("kept").select("row_key").distinct()
    return named.hint("merge").join(kept, "row_key", "left_semi").drop("row_key")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates (0.8 of five-word shingles) and all rows outside groups.

    Rows without an id are in no group and stay, as do null and blank texts; repeated rows of a kept id all stay.
    """
    return _only(_documents(docs), near_duplicates(docs), "kept AND doc_id IS NOT NULL")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item; null and blank texts hold none, and a null id makes no difference."""
    return drop_leaking(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind; n_chars follows the new text.

    A null text stays null, and a row without a span keeps its n_chars as it is; every row comes out once.
    """
    found = find_personal_data(docs.withColumn("blank", F.col("text").isNull()), keep=("lang", "source", "n_chars", "blank"))
    text = F.when(~F.col("blank"), redacted("text", "spans"))
    out = found.withColumn("clean", text)
    size = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("clean").alias("text"), "lang", "source", size.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each row the mix takes; rows of which it takes none leave, so do null and blank texts.

    Rows of equal id and text have equal shares together; null ids and sources mix like others.
    """
    mixed = mix_sources(docs, keep=("text", "lang", "source"))
    return mixed.where("taken > 0").select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: Expectation-maximisation and connected components are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written, and read again for the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.table(name, stage(spark, docs, sf_dir))
    return docs
