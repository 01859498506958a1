"""Shapes as WKT, made and read in SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rings(geom: Column) -> Column:
    """The rings of a WKT polygon or multipolygon, or the runs of other shapes, each an array of points (x, y)."""
    parts = F.filter(F.split(F.regexp_replace(geom, r"[A-Za-z]{3,}|\(", " "), r"\)"), lambda r: r.rlike("[0-9]"))

    def point(p: Column) -> Column:
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.transform(parts, lambda r: F.transform(F.filter(F.split(r, ","), lambda p: p.rlike("[0-9]")), point))


def centroid(geom: Column) -> Column:
    """(x, y) of a shape: of a polygon its area's centre, holes taken off by their turn; of others, or of no area, the mean of its points; NULL for none."""
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("a", "x", "y", "sx", "sy", "n")))

    def add(t: Column, ring: Column) -> Column:
        pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        first = ring[0]  # coordinates are taken from the ring's first point, so that large ones don't cancel

        def side(s: Column, e: Column) -> Column:
            px, py, qx, qy = (e[v][axis] - first[axis] for v in "pq" for axis in "xy")
            cross = px * qy - qx * py
            return F.struct((s["a"] + cross).alias("a"), (s["x"] + (px + qx) * cross).alias("x"), (s["y"] + (py + qy) * cross).alias("y"))

        got = F.aggregate(pairs, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), side)
        mean = F.aggregate(ring, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
        return F.struct((t["a"] + got["a"]).alias("a"), (t["x"] + got["x"] + 3 * got["a"] * first["x"]).alias("x"), (t["y"] + got["y"] + 3 * got["a"] * first["y"]).alias("y"), (t["sx"] + mean["x"]).alias("sx"), (t["sy"] + mean["y"]).alias("sy"), (t["n"] + F.size(ring)).alias("n"))

    s = F.aggregate(rings(geom), zero, add)
    area = geom.rlike("(?i)polygon") & (s["a"] != 0)
    return F.when(s["n"] > 0, F.struct(F.when(area, s["x"] / (3 * s["a"])).otherwise(s["sx"] / s["n"]).alias("x"), F.when(area, s["y"] / (3 * s["a"])).otherwise(s["sy"] / s["n"]).alias("y")))


def _ring(x, y, corners: int) -> Column:
    at = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.pmod(i, F.lit(corners)) * (2 * math.pi / corners))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(at, lambda t: F.concat_ws(" ", x(t).cast("string"), y(t).cast("string"))), ", "), F.lit("))"))


def circle(cx: Column, cy: Column, radius: Column, corners: int = 72) -> Column:
    return _ring(lambda t: cx + radius * F.cos(t), lambda t: cy + radius * F.sin(t), corners)


def ellipse(cx: Column, cy: Column, major: Column, minor: Column, degrees: Column, corners: int = 72) -> Column:
    """An ellipse whose longer half axis points `degrees` from the x axis, against the clock."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return _ring(lambda t: cx + major * F.cos(t) * c - minor * F.sin(t) * s, lambda t: cy + major * F.cos(t) * s + minor * F.sin(t) * c, corners)


def line(cx: Column, cy: Column, length: Column, bearing: Column) -> Column:
    """A line about its middle, by its bearing in degrees from north, with the clock."""
    dx, dy = F.sin(F.radians(bearing)) * length / 2, F.cos(F.radians(bearing)) * length / 2
    ends = [F.concat_ws(" ", (cx + k * dx).cast("string"), (cy + k * dy).cast("string")) for k in (-1, 1)]
    return F.concat(F.lit("LINESTRING ("), ends[0], F.lit(", "), ends[1], F.lit(")"))
