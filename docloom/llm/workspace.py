"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Writes DataFrames as Parquet below ``spark.checkpoint.dir`` and reads them back.

    A written table survives the loss of any executor and is never recomputed. Where the session has no checkpoint
    folder, a temporary folder is set for it if all runs on one machine; on a cluster that is an error, since each
    executor would write to its own disk. Tables that a lazy result still reads stay; ``drop`` removes the others.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="docloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def tasks(self, rows: int, each: int, a_core: int = 4) -> int:
        """How many tasks write a table: some for every core, and enough that none gets many more rows than ``each``."""
        return max(a_core * self.spark.sparkContext.defaultParallelism, -(-rows // each))

    def table(self, name: str, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """Writes and reads again; ``tasks`` bounds the number of files (a table of few rows in many files costs only time)."""
        path = f"{self.root}/{name}"
        df = df.coalesce(tasks) if tasks else df
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
