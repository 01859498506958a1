"""Sources and sinks of layers: delimited text, JSON, Parquet, GeoPackage; a layer has fid, x, y, attributes, and geom (WKT) where there is one."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import centroid

#: Delimiters of the text sink, by name.
DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "space": " "}


def read_layer(spark: SparkSession, path: str, kind: str = "parquet", fid: str | None = None, x: str = "x", y: str = "y", geom: str | None = None, **options) -> DataFrame:
    """A layer from Parquet, CSV (with a header) or JSON lines. With geom, a column of WKT polygons, x and y are its centroid.

    Without fid, rows are numbered: the numbers are unique, but not without gaps.
    """
    options = {"header": True, "inferSchema": True} | options if kind == "csv" else options
    df = spark.read.format(kind).options(**options).load(path)
    df = df.withColumn("fid", F.col(fid).cast("long") if fid else F.monotonically_increasing_id())
    if geom:
        c = centroid(F.col(geom))
        return df.withColumns({"geom": F.col(geom), "x": c["x"], "y": c["y"]})
    return df.withColumns({"x": F.col(x).try_cast("double"), "y": F.col(y).try_cast("double")})


def wkt(blob: bytes | None) -> str | None:
    """WKT of a GeoPackage geometry (a header, then well-known binary): points, lines, polygons and their collections, in two dimensions."""
    if not blob or blob[:2] != b"GP" or blob[3] >> 4 & 1:  # missing, or marked as empty
        return None
    size = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return _shape(blob, 8 + size)[0]


def _shape(data: bytes, at: int) -> tuple[str, int]:
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at, extra = at + 5, (kind // 1000) if kind < 4000 else 0
    width = 2 + (extra in (1, 2)) + 2 * (extra == 3)
    name = ("", "POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")[kind % 1000]

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    def run(n: int) -> str:
        nonlocal at
        v = struct.unpack_from(f"{order}{n * width}d", data, at)
        at += 8 * n * width
        return ", ".join(f"{v[i * width]!r} {v[i * width + 1]!r}" for i in range(n))

    if name == "POINT":
        return f"POINT ({run(1)})", at
    if name == "LINESTRING":
        return f"LINESTRING ({run(count())})", at
    if name == "POLYGON":
        return "POLYGON (" + ", ".join(f"({run(count())})" for _ in range(count())) + ")", at
    parts = []
    for _ in range(count()):
        part, at = _shape(data, at)
        parts.append(part)
    if name == "GEOMETRYCOLLECTION":
        return f"{name} ({', '.join(parts)})", at
    return f"{name} ({', '.join(p[p.index('('):] for p in parts)})", at


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, rows: int = 100_000) -> DataFrame:
    """A layer of a GeoPackage file, which every executor must be able to open: tasks read ranges of `rows` row numbers each."""
    uri = f"file:{path}?mode=ro&immutable=1"
    con = sqlite3.connect(uri, uri=True)
    try:
        found = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        if layer is not None:
            found = [f for f in found if f[0] == layer]
        if not found:
            raise ValueError(f"no layer {layer or ''} in {path}")
        table, geometry = found[0]
        columns = [(r[1], r[2].upper()) for r in con.execute(f'PRAGMA table_info("{table}")') if r[1] != geometry and not r[5]]
        low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    finally:
        con.close()
    kinds = {"INTEGER": "long", "MEDIUMINT": "long", "INT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean"}
    schema = "fid long, " + "".join(f"`{c}` {kinds.get(k, 'string')}, " for c, k in columns) + "geom string"
    names = ["fid", *(c for c, _ in columns), "geom"]
    picked = ", ".join(f'"{c}"' for c in (*(c for c, _ in columns), geometry))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        con = sqlite3.connect(uri, uri=True)
        try:
            for b in batches:
                for start in b["id"].tolist():
                    got = con.execute(f'SELECT rowid, {picked} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (start, start + rows)).fetchall()
                    yield pd.DataFrame([(*r[:-1], wkt(r[-1])) for r in got], columns=names)
        finally:
            con.close()

    starts = spark.range(low, high + 1, rows) if low is not None else spark.range(0)
    df = starts.mapInPandas(read, schema)
    c = centroid(F.col("geom"))
    return df.withColumns({"x": c["x"], "y": c["y"]})


def export_text(df: DataFrame, path: str, fields: list[str] | None = None, delimiter: str = "comma", coordinates: bool = True) -> None:
    """Delimited text with a header: optional X_COORD and Y_COORD first, then the fields; NULL is empty."""
    fields = fields or [c for c in df.columns if c not in ("x", "y", "geom")]
    first = [F.col("x").alias("X_COORD"), F.col("y").alias("Y_COORD")] if coordinates else []
    df.select(*first, *(F.col(f"`{c}`") for c in fields)).write.mode("overwrite").csv(path, header=True, sep=DELIMITERS[delimiter], nullValue="", emptyValue="")


def export_summary(df: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON lines, or as CSV with a header."""
    if kind not in ("json", "csv"):
        raise ValueError(f"no format {kind!r}")
    out = df.write.mode("overwrite")
    out.json(path, ignoreNullFields=False) if kind == "json" else out.csv(path, header=True)


def attach(layer: DataFrame, result: DataFrame) -> DataFrame:
    """Every row of the layer, with the result's columns (by fid; NULL where a row has none); a column that both have comes from the result."""
    own = [c for c in layer.columns if c == "fid" or c not in result.columns]
    return layer.select(*(F.col(f"`{c}`") for c in own)).join(result, "fid", "left")
