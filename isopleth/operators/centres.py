"""Centres, direction and dispersion: one pass of sums each; the iterative centre takes one pass a step."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..layer import Statement, cust

_MEAN = """s AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w) AS tw, count(*) AS n FROM {cust} WHERE w >= 0)
SELECT round(mx, 8) AS mean_x, round(my, 8) AS mean_y, round(tw, 4) AS total_w, CAST(n AS BIGINT) AS input_n, concat('POINT (', CAST(CAST(round(mx, 3) AS DECIMAL(20,3)) AS STRING), ' ', CAST(CAST(round(my, 3) AS DECIMAL(20,3)) AS STRING), ')') AS geom FROM s"""
_STD = """c AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM {cust}),
v AS (SELECT max(mx) AS mx, max(my) AS my, sqrt(sum(w * (x - mx) * (x - mx)) / sum(w) + sum(w * (y - my) * (y - my)) / sum(w)) AS sd, count(*) AS n FROM {cust} CROSS JOIN c)
SELECT round(mx, 8) AS mean_x, round(my, 8) AS mean_y, round(sd, 8) AS std_dist, 1 AS multiplier, round(sd, 8) AS radius, CAST(n AS BIGINT) AS input_n FROM v"""
_SDE = """c AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM {cust}),
m AS (SELECT max(mx) AS mx, max(my) AS my, sum(w * (x - mx) * (x - mx)) / sum(w) AS sxx, sum(w * (y - my) * (y - my)) / sum(w) AS syy, sum(w * (x - mx) * (y - my)) / sum(w) AS sxy, count(*) AS n FROM {cust} CROSS JOIN c),
t AS (SELECT *, 0.5D * atan2(2 * sxy, sxx - syy) AS th FROM m),
a AS (SELECT *, sqrt(greatest(0D, sxx * cos(th) * cos(th) + 2 * sxy * sin(th) * cos(th) + syy * sin(th) * sin(th))) AS a1, sqrt(greatest(0D, sxx * sin(th) * sin(th) - 2 * sxy * sin(th) * cos(th) + syy * cos(th) * cos(th))) AS a2 FROM t)
SELECT round(mx, 8) AS mean_x, round(my, 8) AS mean_y, round(degrees(th), 6) AS rotation, round(greatest(a1, a2), 8) AS semi_major, round(least(a1, a2), 8) AS semi_minor, CAST(n AS BIGINT) AS input_n FROM a"""
_LDM = """s AS (SELECT sum(ex - sx) AS dx, sum(ey - sy) AS dy, avg(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))) AS ml, avg((sx + ex) / 2) AS cx, avg((sy + ey) / 2) AS cy, count(*) AS n FROM {lines}),
a AS (SELECT *, degrees(atan2(dx, dy)) AS b FROM s)
SELECT round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS mean_angle, round(ml, 8) AS mean_length, round(cx, 8) AS center_x, round(cy, 8) AS center_y, CAST(n AS BIGINT) AS line_count FROM a"""
# Copies of a place add up first; distances then go between distinct places.
_CENTRAL = """p AS (SELECT x, y, sum(w) AS w, min(fid) AS fid FROM {cust} GROUP BY x, y),
t AS (SELECT a.fid, sum(b.w * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS total FROM p a CROSS JOIN p b GROUP BY a.fid),
r AS (SELECT fid, total, row_number() OVER (ORDER BY round(total, 4), fid) AS r FROM t)
SELECT fid, 1 AS is_central, round(total, 3) AS total_distance FROM r WHERE r = 1"""


def median_center(df: DataFrame, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weiszfeld's iteration from the mean centre over x, y, w; one aggregate each step."""
    df = df.select("x", "y", "w").persist()
    s = df.agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum("w").alias("w")).first()
    if not s["w"] or s["w"] <= 0:
        raise ValueError("weights must have a positive sum")
    x, y, total = s["x"] / s["w"], s["y"] / s["w"], 0.0
    for _ in range(steps):
        d = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
        q = F.col("w") / F.greatest(d, F.lit(1e-12))
        r = df.agg(F.sum(q * F.col("x")).alias("x"), F.sum(q * F.col("y")).alias("y"), F.sum(q).alias("q"), F.sum(F.col("w") * d).alias("t")).first()
        nx, ny, total = r["x"] / r["q"], r["y"] / r["q"], r["t"]
        moved, x, y = math.hypot(nx - x, ny - y), nx, ny
        if moved < tolerance:
            break
    df.unpersist()
    return df.sparkSession.createDataFrame([(x, y, total)], "median_x double, median_y double, total_dist double")


def standard_circle(row: DataFrame) -> DataFrame:
    """The standard distance's row with its circle as a polygon."""
    return row.withColumn("geom", geometry.circle(F.col("mean_x"), F.col("mean_y"), F.col("radius")))


def deviational_ellipse(row: DataFrame) -> DataFrame:
    """The directional distribution's row with its ellipse as a polygon."""
    return row.withColumn("geom", geometry.ellipse(F.col("mean_x"), F.col("mean_y"), F.col("semi_major"), F.col("semi_minor"), F.col("rotation")))


def mean_line(row: DataFrame) -> DataFrame:
    """The directional mean's row with its line."""
    return row.withColumn("geom", geometry.line(F.col("center_x"), F.col("center_y"), F.col("mean_length"), F.col("mean_angle")))


STATEMENTS = {
    "mean_center": Statement(_MEAN, ("cust",)),
    "standard_distance": Statement(_STD, ("cust",)),
    "directional_distribution": Statement(_SDE, ("cust",)),
    "linear_directional_mean": Statement(_LDM, ("lines",)),
    "central_feature": Statement(_CENTRAL, ("cust",)),
}
QUERIES = {
    "median_center": lambda spark, sf_dir: median_center(cust(spark, sf_dir)).select(F.round("median_x", 4).alias("median_x"), F.round("median_y", 4).alias("median_y"), F.round("total_dist", 2).alias("total_dist")),
    "standard_distance_circle": lambda spark, sf_dir: standard_circle(STATEMENTS["standard_distance"].query(spark, sf_dir)),
    "directional_distribution_ellipse": lambda spark, sf_dir: deviational_ellipse(STATEMENTS["directional_distribution"].query(spark, sf_dir)),
    "linear_directional_mean_line": lambda spark, sf_dir: mean_line(STATEMENTS["linear_directional_mean"].query(spark, sf_dir)),
}
