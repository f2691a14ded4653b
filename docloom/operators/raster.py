"""Image difference metrics over pixels in long form: (img, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def read_pnm(files: DataFrame) -> DataFrame:
    """Pixels of ASCII grey or colour maps (path, text): P2 or P3, comments dropped, values scaled to 255."""
    clean = F.regexp_replace("text", r"#[^\n]*", "")
    t = files.select("path", F.filter(F.split(clean, r"\s+"), lambda x: x != "").alias("t"))
    head = t.select("path", (F.col("t")[0] == "P3").alias("colour"), F.col("t")[1].cast("int").alias("w"), F.col("t")[3].cast("int").alias("top"), F.slice("t", 5, 2**30).alias("v"))
    head = head.withColumn("step", F.when(F.col("colour"), 3).otherwise(1))
    long = head.select("path", "w", "step", "top", "v", F.explode(F.sequence(F.lit(0), F.expr("size(v) div step - 1"))).alias("i"))
    value = lambda k: F.floor(F.expr(f"cast(v[i * step + least({k}, step - 1)] AS int)") * 255 / F.col("top")).cast("int")
    return long.select(F.col("path").alias("img"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.expr("cast(i div w AS int)").alias("y"), *[value(k).alias(c) for k, c in enumerate("rgb")], F.lit(255).alias("a"))


def image_diff(baseline: DataFrame, candidate: DataFrame, by: str = "img", tolerance: int = 0, mask: DataFrame | None = None, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row an image: pixels, masked and changed ones, share changed, mean absolute error, largest delta, bounds.

    A pixel changed if any channel differs by more than the tolerance. A pixel that only one side has differs by 255 in
    every channel and counts as ``unmatched``, so images of unequal size never look alike. Masked pixels (any of r, g, b at 128 or over in
    the mask) are not compared.
    """
    keys = [by, "x", "y"]
    side = lambda df, p, there: df.select(*keys, there, *[F.col(c).alias(f"{p}{c}") for c in channels])
    both = side(baseline.withColumn("_p", F.lit(1)), "p", "_p").join(side(candidate.withColumn("_q", F.lit(1)), "q", "_q"), keys, "full_outer")
    both = both.withColumn("unmatched", F.col("_p").isNull() | F.col("_q").isNull())
    if mask is not None:
        both = both.join(mask.select(*keys, (F.greatest("r", "g", "b") >= 128).alias("ignored")), keys, "left")
    else:
        both = both.withColumn("ignored", F.lit(False))
    deltas = [F.when(F.col("unmatched"), 255).otherwise(F.abs(F.col(f"p{c}") - F.col(f"q{c}"))) for c in channels]
    most = deltas[0] if len(deltas) == 1 else F.greatest(*deltas)
    live = ~F.coalesce("ignored", F.lit(False))
    both = both.withColumn("live", live).withColumn("delta", F.when(live, most)).withColumn("total", F.when(live, sum(deltas[1:], deltas[0]))).withColumn("changed", live & (most > tolerance))
    at = lambda f, c: f(F.when(F.col("changed"), F.col(c)))
    out = both.groupBy(by).agg(
        F.count("*").alias("pixels"), F.count_if("unmatched").alias("unmatched"), F.count_if(~F.col("live")).alias("masked"), F.count_if("changed").alias("changed"), F.sum("total").alias("absolute"), F.max("delta").alias("max_delta"),
        at(F.min, "x").alias("x0"), at(F.min, "y").alias("y0"), at(F.max, "x").alias("x1"), at(F.max, "y").alias("y1"),
    )
    compared = F.col("pixels") - F.col("masked")
    return out.withColumn("changed_fraction", F.try_divide("changed", compared)).withColumn("mean_absolute_error", F.try_divide("absolute", compared * len(channels))).withColumn("masked_fraction", F.try_divide("masked", "pixels"))


def verdict(metrics: DataFrame, max_fraction: float, max_mean: float, max_delta: float, max_masked: float = 1.0) -> DataFrame:
    good = (F.col("unmatched") == 0) & (F.col("changed_fraction") <= max_fraction) & (F.col("mean_absolute_error") <= max_mean) & (F.col("max_delta") <= max_delta) & (F.col("masked_fraction") <= max_masked)
    return metrics.withColumn("verdict", F.when(good, "passed").otherwise("failed"))
