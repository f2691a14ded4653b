"""Streams: new documents exactly once, quiescent files, and edit sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, path: str, seed: DataFrame | None = None, glob: str = "*.md", max_files: int | None = None) -> DataFrame:
    """A stream of (name, text): each file name once, for good.

    Names in ``seed`` (those that were there before the watch) never appear. There is no watermark on purpose: a name
    that is deleted and comes again stays seen, so the state grows with the number of names. The query's checkpoint
    holds the state and lets one consumer run at a time.
    """
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    found = reader.load(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    if seed is not None:
        found = found.join(seed.select("name").distinct(), "name", "left_anti")
    return found.dropDuplicates(["name"])


def quiescent(observations: DataFrame, polls: int = 3) -> DataFrame:
    """From a stream of (name, seq, fingerprint): (name, seq) once a fingerprint was seen ``polls`` times in a row."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, told = state.get if state.exists else ("", 0, False)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            run = run + 1 if row.fingerprint == last else 1
            told = told and row.fingerprint == last
            last = row.fingerprint
            if run >= polls and not told:
                told = True
                out.append((key[0], row.seq))
        state.update((last, run, told))
        yield pd.DataFrame(out, columns=["name", "seq"])

    return observations.groupBy("name").applyInPandasWithState(step, "name string, seq long", "last string, run int, told boolean", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and window, late ones until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
