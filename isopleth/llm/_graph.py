"""Connected components of an edge list, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Every node links its larger (large star) or its smaller neighbours and itself to the smallest of them."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(high.alias("u"), low.alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    linked = seen.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches), for every node of an edge (u, v)."""
    edges = materialize(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    before = None
    while True:
        edges = materialize(_star(_star(edges, True), False))
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
