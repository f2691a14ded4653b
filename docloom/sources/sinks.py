"""Writing results: one table, or several that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_exclusive(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a table that must not be there yet; Spark's committer makes it appear whole."""
    df.write.format(fmt).mode("errorifexists").save(path)


def publish_together(spark: SparkSession, outputs: dict[str, DataFrame], fmt: str = "parquet", replace: bool = False) -> None:
    """Writes all tables beside their places, then moves them in; if a move fails, those made are undone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = {p: path(p).getFileSystem(conf) for p in outputs}
    taken = [p for p in outputs if fs[p].exists(path(p))]
    if taken and not replace:
        raise FileExistsError(f"already there: {', '.join(taken)}")
    done: list[str] = []
    try:
        for p, df in outputs.items():
            df.write.format(fmt).mode("overwrite").save(f"{p}.staged")
        for p in outputs:
            if fs[p].exists(path(p)) and not fs[p].rename(path(p), path(f"{p}.backup")):
                raise OSError(f"cannot set {p} aside")
            if not fs[p].rename(path(f"{p}.staged"), path(p)):
                raise OSError(f"cannot publish {p}")
            done.append(p)
    except Exception:
        for p in outputs:
            if p in done:
                fs[p].delete(path(p), True)
            if fs[p].exists(path(f"{p}.backup")):
                fs[p].rename(path(f"{p}.backup"), path(p))
        raise
    finally:
        for p in outputs:
            fs[p].delete(path(f"{p}.staged"), True)
    for p in outputs:
        fs[p].delete(path(f"{p}.backup"), True)
