"""Neighbourhood graphs as edge DataFrames (src, dst, d2 or w).

For a distance join points fall into square cells, so it is an equi-join of cells with their eight neighbours, and
candidates grow with the pairs that are found. Nearest neighbours come from the leaves of a tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rings
from .store import stored
from .tree import Tree


def points(df: DataFrame) -> DataFrame:
    """fid, x, y of the rows that have finite coordinates."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") != float("inf")) & (F.abs("y") != float("inf"))
    return df.filter(ok).select("fid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _cells(pts: DataFrame, size: float) -> DataFrame:
    return pts.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})


def _pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Ordered pairs of different points in the same or touching cells, with squared distance."""
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = _cells(left, size).withColumn("s", F.explode(step)).select(F.col("fid").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    b = _cells(right, size).select(F.col("fid").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy")
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    return a.join(b, ["cx", "cy"]).filter(F.col("src") != F.col("dst")).select("src", "dst", d2.alias("d2"))


def within(df: DataFrame, distance: float) -> DataFrame:
    """src, dst, d2 of all ordered pairs at most distance apart."""
    if not distance > 0:
        raise ValueError("distance must be positive")
    pts = points(df)
    return _pairs(pts, pts, distance).filter(F.col("d2") <= float(distance) ** 2)


#: Places in a leaf of the tree, and of the sample that shapes it: at most SAMPLE places come to the driver.
LEAF, SAMPLE = 2_048, 1_000_000


def _best(src: tuple[np.ndarray, ...], dst: tuple[np.ndarray, ...], k: int) -> list[list[dict]]:
    """For each place (x, y) in src the k nearest of dst (x, y, id), ties by id."""
    out: list[list[dict]] = []
    x, y, ids = dst
    for a in range(0, len(src[0]), max(1, 4_000_000 // max(1, len(x)))):
        z = a + max(1, 4_000_000 // max(1, len(x)))
        d2 = (src[0][a:z, None] - x) * (src[0][a:z, None] - x) + (src[1][a:z, None] - y) * (src[1][a:z, None] - y)
        if len(x) > k:
            row, col = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
        else:
            row, col = (v.reshape(-1) for v in np.indices(d2.shape))
        d = d2[row, col]
        order = np.lexsort((ids[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, np.arange(len(d2)))
        keep = np.arange(len(row)) - first[row] < k
        row, col, d = row[keep], col[keep], d[keep]
        cuts = np.searchsorted(row, np.arange(len(d2) + 1)).tolist()
        flat = [{"d2": p, "dst": q} for p, q in zip(d.tolist(), ids[col].tolist(), strict=True)]
        out += [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def nearest(df: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """src, dst, d2, r for the k nearest other points of each point; ties by id.

    Points at one place count as one, known by its k + 1 smallest ids, so a place that many share costs no more than
    another. A k-d tree over a sample deals places to leaves of about `leaf` places. Each leaf finds its own places'
    nearest; a place whose circle through the k-th leaves its leaf is compared with the leaves that it reaches, too.
    """
    spark = df.sparkSession
    pts = points(df).withColumn("fid", F.col("fid").cast("long"))
    by = Window.partitionBy("x", "y").orderBy("fid")
    few = pts.withColumn("q", F.row_number().over(by)).filter(F.col("q") <= k + 1)
    places = stored(few.groupBy("x", "y").agg(F.sort_array(F.collect_list("fid")).alias("ids")))
    n, least = places.agg(F.count("*"), F.sum(F.size("ids"))).first()
    if not n or least < 2:
        return spark.createDataFrame([], "src long, dst long, d2 double, r int")
    share = min(1.0, SAMPLE / n)
    picked = places.select("x", "y")
    if share < 1:
        picked = picked.filter(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < int((1 << 30) * share))
    got = picked.toArrow()  # at most about SAMPLE places
    tree = Tree(got["x"].to_numpy(), got["y"].to_numpy(), max(8, int(max(leaf, 4 * k) * share)))
    sent, near = spark.sparkContext.broadcast(tree), "array<struct<d2:double,dst:long>>"

    @F.pandas_udf("long")
    def leaf_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(sent.value.leaf_of(x.to_numpy(), y.to_numpy()))

    def flat(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
        size = part["ids"].map(len).to_numpy()
        return np.repeat(part["x"].to_numpy(), size), np.repeat(part["y"].to_numpy(), size), np.concatenate([np.asarray(v) for v in part["ids"]])

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        best = _best((part["x"].to_numpy(), part["y"].to_numpy()), flat(part), k + 1)
        own, t = int(part["leaf"].iat[0]), sent.value
        reach = [b[-1]["d2"] if len(b) == k + 1 else float("inf") for b in best]
        others = [t.reached(x, y, r, own) if t.leaves > 1 else [] for x, y, r in zip(part["x"], part["y"], reach, strict=True)]
        return pd.DataFrame({"x": part["x"], "y": part["y"], "near": best, "others": others})

    def outside(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(part):
            return pd.DataFrame({"x": [], "y": [], "near": []})
        return pd.DataFrame({"x": asked["x"], "y": asked["y"], "near": _best((asked["x"].to_numpy(), asked["y"].to_numpy()), flat(part), k + 1)})

    dealt = places.withColumn("leaf", leaf_of("x", "y"))
    found = dealt.groupBy("leaf").applyInPandas(inside, f"x double, y double, near {near}, others array<long>")
    best = found.select("x", "y", "near")
    if tree.leaves > 1:
        found = stored(found)
        asked = found.select("x", "y", F.explode("others").alias("leaf"))
        more = asked.groupBy("leaf").cogroup(dealt.groupBy("leaf")).applyInPandas(outside, f"x double, y double, near {near}")
        best = found.select("x", "y", "near").unionByName(more).groupBy("x", "y").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda v: v["dst"] != F.col("fid")), 1, k)
    rows = pts.join(best, ["x", "y"]).select(F.col("fid").alias("src"), F.posexplode(others).alias("r", "v"))
    return rows.select("src", F.col("v.dst").alias("dst"), F.col("v.d2").alias("d2"), (F.col("r") + 1).alias("r"))


def lattice(df: DataFrame, queen: bool = True) -> DataFrame:
    """src, dst of unit cells (fid, col, row) that share a side, or also a corner if queen."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (queen or not (i and j))]
    a = df.select(F.col("fid").alias("src"), F.explode(F.array(*(F.struct((F.col("col") + i).alias("col"), (F.col("row") + j).alias("row")) for i, j in steps))).alias("s"))
    return a.select("src", "s.col", "s.row").join(df.select(F.col("fid").alias("dst"), "col", "row"), ["col", "row"]).select("src", "dst")


def contiguity(df: DataFrame, queen: bool = True) -> DataFrame:
    """src, dst of polygons (fid, geom: WKT) whose boundaries meet; without queen, along a line or across.

    Sides fall into the grid cells of their boxes, cells are joined, and exact orientation tests decide, so only sides
    that are near meet, and corners that touch the middle of a side count. One polygon inside another isn't found.
    """
    at = df.filter(F.col("geom").isNotNull()).select("fid", F.explode(rings(F.col("geom"))).alias("r"))
    pairs = F.arrays_zip(F.slice("r", 1, F.greatest(F.lit(0), F.size("r") - 1)).alias("a"), F.slice("r", 2, F.greatest(F.lit(0), F.size("r") - 1)).alias("b"))
    sides = at.select("fid", F.explode(pairs).alias("s")).select("fid", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).filter("ax <> bx or ay <> by")
    sides = stored(sides.withColumn("sid", F.monotonically_increasing_id()))
    size = sides.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
    if not size:
        return df.sparkSession.createDataFrame([], "src long, dst long")

    def cells(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))

    grid = sides.withColumn("cx", cells("ax", "bx")).withColumn("cy", cells("ay", "by"))
    left = grid.select("cx", "cy", *(F.col(c).alias(f"l_{c}") for c in ("fid", "ax", "ay", "bx", "by")))
    both = left.join(grid, ["cx", "cy"]).filter("l_fid < fid")

    def turn(p: str, q: str, r: str) -> Column:
        """the sign of the turn from p over q to r"""
        px, py, qx, qy, rx, ry = (F.col(f"{v}{axis}") for v in (p, q, r) for axis in "xy")
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    d1, d2, d3, d4 = turn("l_a", "l_b", "a"), turn("l_a", "l_b", "b"), turn("a", "b", "l_a"), turn("a", "b", "l_b")
    over = [F.least(F.greatest(f"l_a{v}", f"l_b{v}"), F.greatest(f"a{v}", f"b{v}")) - F.greatest(F.least(f"l_a{v}", f"l_b{v}"), F.least(f"a{v}", f"b{v}")) for v in "xy"]
    boxes = (over[0] >= 0) & (over[1] >= 0)
    if queen:
        meet = boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)
    else:
        along = (d1 == 0) & (d2 == 0) & boxes & (F.greatest(*over) > 0)
        meet = along | ((d1 * d2 < 0) & (d3 * d4 < 0))
    found = both.filter(meet).select(F.col("l_fid").alias("src"), F.col("fid").alias("dst")).distinct()
    return found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def row_standardised(edges: DataFrame) -> DataFrame:
    """src, dst, w with w = 1 / number of the source's neighbours."""
    n = edges.groupBy("src").agg(F.count("*").alias("m"))
    return edges.join(n, "src").select("src", "dst", (F.lit(1.0) / F.col("m")).alias("w"))


def restricted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes (fid) only, standardised anew."""
    ids = nodes.select("fid")
    kept = edges.join(ids.withColumnRenamed("fid", "src"), "src", "left_semi").join(ids.withColumnRenamed("fid", "dst"), "dst", "left_semi")
    return row_standardised(kept.select("src", "dst"))
