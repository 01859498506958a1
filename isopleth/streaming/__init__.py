"""Mergeable statistics over event-time windows; the sums are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean_center(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Weighted mean centre and standard distance of x, y, w for each window."""
    w = F.col("w")
    sums = stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(*(F.sum(w * e).alias(n) for n, e in (("sw", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")))))
    mx, my = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
    return sums.select("window", mx.alias("mean_x"), my.alias("mean_y"), F.sqrt(F.greatest(F.lit(0.0), F.col("sxx") / F.col("sw") - mx * mx + F.col("syy") / F.col("sw") - my * my)).alias("std_dist"))
