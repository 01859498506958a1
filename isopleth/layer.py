"""Layers over tables: fid, x, y and attributes; each with the SQL that defines it elsewhere."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import neighbours
from .plans.ranks import ranked
from .plans.store import stored

K, BAND = 8, 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_numeric(column):
    """NaN and infinities count as missing, as text that isn't a number does."""
    c = column.try_cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), *(e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "v1", "v2", "v3", "v4"))), F.col("label").alias("cat"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), *(e[i].cast("double").alias(n) for i, n in enumerate(("sx", "sy", "ex", "ey"))))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    v = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("m"))
    return n.join(v, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("fid"), (F.col("n_nationkey") % 5).cast("long").alias("col"), F.floor(F.col("n_nationkey") / 5).alias("row"), F.coalesce(F.round(F.col("s") / F.col("m"), 4), F.lit(0)).cast("double").alias("value"), F.coalesce("m", F.lit(0)).cast("double").alias("size"))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as polygons."""
    x, y = F.col("col"), F.col("row")
    corners = F.array_join(F.array(*(F.concat_ws(" ", (x + i).cast("string"), (y + j).cast("string")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))), ", ")
    return cells(spark, sf_dir).select("fid", F.concat(F.lit("POLYGON (("), corners, F.lit("))")).alias("geom"))


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fid"), F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x1"), F.col("l_discount").cast("double").alias("x2"), F.col("l_tax").cast("double").alias("x3"), F.col("l_returnflag").alias("regime"), (F.col("l_linestatus") == "F").cast("int").alias("bin"))


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("fid"), (F.col("c_custkey") % 101).cast("double").alias("x"), (F.col("c_custkey") % 103).cast("double").alias("y"), F.col("c_acctbal").cast("double").alias("v"), F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("w"))


_kept = stored


_NUM = re.compile(r"(?<![\w.])(\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)D\b")

_PERMS = "SELECT range AS perm FROM range(1, {})"


def _perms(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "perm")


#: For each input of a statement: how Spark makes it, and its definition in plain SQL.
INPUTS = {
    "pts": (pts, "SELECT vec_id AS fid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v1, CAST(embedding[4] AS DOUBLE) AS v2, CAST(embedding[5] AS DOUBLE) AS v3, CAST(embedding[6] AS DOUBLE) AS v4, label AS cat FROM embeddings"),
    "lines": (lines, "SELECT vec_id AS fid, CAST(embedding[1] AS DOUBLE) AS sx, CAST(embedding[2] AS DOUBLE) AS sy, CAST(embedding[3] AS DOUBLE) AS ex, CAST(embedding[4] AS DOUBLE) AS ey FROM embeddings"),
    "cells": (cells, "SELECT CAST(n_nationkey AS BIGINT) AS fid, CAST(n_nationkey % 5 AS BIGINT) AS col, CAST(n_nationkey // 5 AS BIGINT) AS row, CAST(coalesce(round(s / m, 4), 0) AS DOUBLE) AS value, CAST(coalesce(m, 0) AS DOUBLE) AS size FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, sum(c_acctbal) AS s, count(*) AS m FROM customer GROUP BY 1) USING (n_nationkey)"),
    "reg": (reg, "SELECT l_orderkey * 10 + l_linenumber AS fid, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) AS x3, l_returnflag AS regime, CAST(l_linestatus = 'F' AS INTEGER) AS bin FROM lineitem"),
    "cust": (cust, "SELECT CAST(c_custkey AS BIGINT) AS fid, CAST(c_custkey % 101 AS DOUBLE) AS x, CAST(c_custkey % 103 AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) AS v, greatest(CAST(c_acctbal AS DOUBLE), 0) AS w FROM customer"),
    "knn": (lambda s, d: _kept(neighbours.row_standardised(neighbours.nearest(pts(s, d), K))), f"SELECT src, dst, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY src) AS w FROM (SELECT a.fid AS src, b.fid AS dst, row_number() OVER (PARTITION BY a.fid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.fid) AS r FROM pts a JOIN pts b ON a.fid <> b.fid) WHERE r <= {K}"),
    "nn": (lambda s, d: _kept(neighbours.nearest(pts(s, d), K)), f"SELECT src, dst, d2, r FROM (SELECT a.fid AS src, b.fid AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2, row_number() OVER (PARTITION BY a.fid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.fid) AS r FROM pts a JOIN pts b ON a.fid <> b.fid) WHERE r <= {K}"),
    "band": (lambda s, d: _kept(neighbours.within(pts(s, d), BAND)), f"SELECT a.fid AS src, b.fid AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM pts a JOIN pts b ON a.fid <> b.fid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= CAST({BAND} AS DOUBLE) * CAST({BAND} AS DOUBLE)"),
    "queen": (lambda s, d: _kept(neighbours.row_standardised(neighbours.contiguity(squares(s, d)))), "SELECT src, dst, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY src) AS w FROM (SELECT a.fid AS src, b.fid AS dst FROM cells a JOIN cells b ON a.fid <> b.fid AND abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1)"),
    "rook": (lambda s, d: _kept(neighbours.row_standardised(neighbours.contiguity(squares(s, d), False))), "SELECT src, dst, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY src) AS w FROM (SELECT a.fid AS src, b.fid AS dst FROM cells a JOIN cells b ON abs(a.col - b.col) + abs(a.row - b.row) = 1)"),
    "perms": (lambda s, d: _perms(s, 999), _PERMS.format(1000)),
    "perms199": (lambda s, d: _perms(s, 199), _PERMS.format(200)),
    "perms99": (lambda s, d: _perms(s, 99), _PERMS.format(100)),
    "bands": (lambda s, d: s.range(1, 11).select((F.col("id") * 0.03).alias("d")), "SELECT CAST(range AS DOUBLE) * CAST(0.03 AS DOUBLE) AS d FROM range(1, 11)"),
    "ranked": (lambda s, d: _kept(ranked(pts(s, d), ["fid"])), "SELECT *, row_number() OVER (ORDER BY fid) AS place FROM pts"),
}
_NEEDS = {"knn": ("pts",), "nn": ("pts",), "band": ("pts",), "queen": ("cells",), "rook": ("cells",), "ranked": ("pts",)}


@dataclass(frozen=True)
class Statement:
    """An operator as one SQL statement over named inputs: CTEs and a final SELECT, without the leading WITH."""

    body: str
    inputs: tuple[str, ...] = field(default=())

    def run(self, spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
        return spark.sql("WITH " + self.body, **{k: frames[k] for k in self.inputs})

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(spark, {k: INPUTS[k][0](spark, sf_dir) for k in self.inputs})

    def oracle(self) -> str:
        names: list[str] = []
        for k in self.inputs:
            names += [x for x in (*_NEEDS.get(k, ()), k) if x not in names]
        views = ", ".join(f"{k} AS ({INPUTS[k][1]})" for k in names)
        body = self.body.format(**{k: k for k in self.inputs})
        return "WITH " + views + ", " + _NUM.sub(r"CAST(\1 AS DOUBLE)", body)
