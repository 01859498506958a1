"""The numbers behind charts: histograms, Lorenz curves, class breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..layer import cust, pts
from ..plans.ranks import ranked


def histogram(df: DataFrame, field: str, bins: int = 20) -> DataFrame:
    """bin (from 0), low, high, n: bins of equal width; the last one holds the largest value. Empty bins are listed, too."""
    lo, hi = df.agg(F.min(field), F.max(field)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (float(hi) - float(lo)) / bins or 1.0
    n = df.filter(F.col(field).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((F.col(field) - float(lo)) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(float(lo)) + F.col("id") * width).alias("low"), (F.lit(float(lo)) + (F.col("id") + 1) * width).alias("high"))
    return every.join(n, "bin", "left").fillna(0, ["n"])


def lorenz(df: DataFrame, field: str, points: int = 100) -> DataFrame:
    """share, cumulative: of the smallest values' share of the rows, their share of the sum, at up to `points` places."""
    d = ranked(df.filter(F.col(field).isNotNull()).select("fid", F.col(field).cast("double").alias("v")), ["v", "fid"])
    n, total = d.agg(F.count("*"), F.sum("v")).first()
    if not n or not total:
        return df.sparkSession.createDataFrame([(0.0, 0.0)], "share double, cumulative double")
    step = d.withColumn("k", F.ceil(F.col("place") * points / n)).groupBy("k").agg(F.max("place").alias("place"), F.sum("v").alias("v"))
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # at most `points` rows
    out = step.select((F.col("place") / n).alias("share"), (F.sum("v").over(run) / total).alias("cumulative"))
    return out.unionByName(df.sparkSession.createDataFrame([(0.0, 0.0)], out.schema)).orderBy("share")


def sigma_breaks(df: DataFrame, field: str, steps: tuple[float, ...] = (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)) -> list[float]:
    """Class breaks at standard deviations about the mean."""
    m, s = df.agg(F.avg(field), F.stddev_pop(field)).first()
    return [] if m is None else [m + k * s for k in steps]


def quantile_breaks(df: DataFrame, field: str, classes: int = 5) -> list[float]:
    """Upper ends of classes that hold equally many of the distinct values."""
    values = df.select(F.col(field).cast("double").alias("v")).filter("v is not null").distinct().withColumn("fid", F.lit(0))
    d = ranked(values, ["v"])
    n = d.count()
    wanted = sorted({-(-n * i // classes) for i in range(1, classes + 1)} - {0})
    return [r["v"] for r in d.filter(F.col("place").isin(wanted)).orderBy("place").collect()]  # a row for each class


def quantile_bins(df: DataFrame, field: str, bins: int = 5, name: str = "stratum") -> DataFrame:
    """df with the number of each value's bin, from 0, between distinct quantiles, upper ends included; NULL stays NULL."""
    at = df.agg(F.percentile(F.col(field).cast("double"), F.array(*(F.lit(i / bins) for i in range(bins + 1))))).first()[0] or []
    inner = sorted(set(at))[1:-1]
    return df.withColumn(name, F.when(F.col(field).isNotNull(), sum(((F.col(field) > e).cast("int") for e in inner), F.lit(0))))


STATEMENTS: dict = {}
QUERIES = {
    "histogram": lambda s, d: histogram(cust(s, d), "v", 10).select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n"),
    "lorenz_curve": lambda s, d: lorenz(cust(s, d).filter("w > 0"), "w", 50).select(F.round("share", 8).alias("share"), F.round("cumulative", 8).alias("cumulative")),
    "quantile_strata": lambda s, d: quantile_bins(pts(s, d), "v1").groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.min("v1"), 8).alias("low"), F.round(F.max("v1"), 8).alias("high")),
}
ORACLES = {
    "histogram": """WITH c AS (SELECT CAST(c_acctbal AS DOUBLE) AS v FROM customer), s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w FROM c),
b AS (SELECT least(9, CAST(floor((v - lo) / w) AS INTEGER)) AS bin, count(*) AS n FROM c, s GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, round(lo + range * w, 4) AS low, round(lo + (range + 1) * w, 4) AS high, coalesce(n, 0) AS n FROM range(10) CROSS JOIN s LEFT JOIN b ON b.bin = range""",
    "lorenz_curve": """WITH c AS (SELECT CAST(c_acctbal AS DOUBLE) AS v, c_custkey AS fid FROM customer WHERE c_acctbal > 0),
r AS (SELECT row_number() OVER (ORDER BY v, fid) AS p, sum(v) OVER (ORDER BY v, fid ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER () AS n, sum(v) OVER () AS t FROM c),
k AS (SELECT CAST(ceil(p * 50 / n) AS INTEGER) AS k, max(p) / any_value(CAST(n AS DOUBLE)) AS share, max(s) / any_value(t) AS cumulative FROM r GROUP BY 1)
SELECT round(share, 8) AS share, round(cumulative, 8) AS cumulative FROM k UNION ALL SELECT 0, 0""",
    "quantile_strata": """WITH p AS (SELECT CAST(embedding[3] AS DOUBLE) AS v FROM embeddings), q AS (SELECT list_distinct(list_value(quantile_cont(v, 0.2), quantile_cont(v, 0.4), quantile_cont(v, 0.6), quantile_cont(v, 0.8))) AS e FROM p)
SELECT CAST(len(list_filter(e, lambda x: v > x)) AS INTEGER) AS stratum, count(*) AS n, round(min(v), 8) AS low, round(max(v), 8) AS high FROM p, q GROUP BY 1""",
}
