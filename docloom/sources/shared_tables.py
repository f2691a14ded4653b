"""Tables in the folder that all executors share, where a plan is cut so that no loss makes it run again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class SharedTables:
    """Writes DataFrames below ``spark.checkpoint.dir`` and reads them back.

    Where the session names no folder, one is made on this machine if all runs there; on a cluster that is an error.
    Tables that a lazy result still reads stay until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            if spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir: executors of a local cluster have folders of their own")
            base = tempfile.mkdtemp(prefix="docloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def cut(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
