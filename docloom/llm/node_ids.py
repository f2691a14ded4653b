"""Ids of any type as 64-bit numbers in the same order, for operators that pack ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from docloom.llm.workspace import Workspace


class NodeIds:
    """Whole numbers stand for themselves. Other ids are numbered in their order by one sort over the cluster, whose
    result is written, so that no retry can number them differently."""

    def __init__(self, docs: DataFrame, id_col: str, workspace: Workspace):
        self.type = docs.schema[id_col].dataType
        self.plain = isinstance(self.type, ByteType | ShortType | IntegerType | LongType)
        self.table = None
        if not self.plain:
            ids = docs.select(F.col(id_col).alias("given")).where("given IS NOT NULL").distinct()
            ordered = ids.repartitionByRange("given").sortWithinPartitions("given")
            self.table = workspace.table("ids", ordered.select("given", F.monotonically_increasing_id().alias("node")))

    def numbered(self, rows: DataFrame, name: str = "id") -> DataFrame:
        """The rows with the id column as a long."""
        if self.plain:
            return rows.withColumn(name, F.col(name).cast("long"))
        return rows.withColumnRenamed(name, "given").join(self.table, "given", "left").withColumnRenamed("node", name).drop("given")

    def given(self, rows: DataFrame, *names: str) -> DataFrame:
        """The rows with the named columns as the caller's ids again."""
        if self.plain:
            return rows.withColumns({n: F.col(n).cast(self.type) for n in names})
        columns = rows.columns
        for n in names:
            rows = rows.join(self.table.withColumnRenamed("node", n), n, "left").drop(n).withColumnRenamed("given", n)
        return rows.select(*columns)
