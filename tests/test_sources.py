import math
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from isopleth import sources, streaming
from isopleth.functions import geometry
from isopleth.operators import charts


def blob(wkb):
    return b"GP\0\1" + struct.pack("<i", 5253) + wkb


def polygon(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom')")
    con.execute("CREATE TABLE zones (fid INTEGER PRIMARY KEY, geom BLOB, density REAL, n MEDIUMINT, name TEXT)")
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    con.execute("INSERT INTO zones VALUES (1, ?, 1.5, 3, 'a')", (blob(polygon(square)),))
    con.execute("INSERT INTO zones VALUES (5, ?, NULL, 4, NULL)", (blob(struct.pack("<BI2d", 1, 1, 7.0, 8.0)),))
    con.execute("INSERT INTO zones VALUES (9, NULL, 2.5, 5, 'c')")
    con.execute("INSERT INTO zones VALUES (12, ?, 0.5, 6, 'd')", (blob(struct.pack("<BII", 1, 6, 2) + polygon(square, hole) + polygon([(10, 0), (11, 0), (11, 1), (10, 1), (10, 0)])),))
    con.commit()
    con.close()
    rows = {r["fid"]: r for r in sources.read_geopackage(spark, path, rows=4).collect()}
    assert set(rows) == {1, 5, 9, 12} and (rows[1]["x"], rows[1]["y"], rows[1]["density"], rows[1]["n"], rows[1]["name"]) == (1, 1, 1.5, 3, "a")
    assert (rows[5]["x"], rows[5]["y"], rows[5]["density"]) == (7, 8, None) and rows[9]["x"] is None and rows[9]["geom"] is None
    assert rows[12]["geom"].startswith("MULTIPOLYGON (((") and rows[12]["x"] == pytest.approx((4 * 1 - 1 * 1.5 + 10.5) / 4)
    with pytest.raises(ValueError):
        sources.read_geopackage(spark, path, "other")


def test_text_layers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 2.0, "a;b", None), (2, None, 3.0, None, 4)], "fid long, x double, y double, name string, n int")
    sources.export_text(df, str(tmp_path / "t"), ["name", "n"], "semicolon")
    lines = [line for f in (tmp_path / "t").glob("part*.csv") for line in f.read_text().splitlines()]
    assert set(lines) == {";3.0;;4", '0.5;2.0;"a;b";', "X_COORD;Y_COORD;name;n"}
    back = sources.read_layer(spark, str(tmp_path / "t"), "csv", x="X_COORD", y="Y_COORD", sep=";").orderBy("y").collect()
    assert [(r["x"], r["y"], r["name"], r["n"]) for r in back] == [(0.5, 2.0, "a;b", None), (None, 3.0, None, 4)]
    for kind in ("json", "csv"):
        sources.export_summary(df, str(tmp_path / kind), kind)
        assert sources.read_layer(spark, str(tmp_path / kind), kind, fid="fid").count() == 2
    shapes = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))",), (None,)], "shape string")
    shapes.write.parquet(str(tmp_path / "p"))
    assert {(r["x"], r["y"]) for r in sources.read_layer(spark, str(tmp_path / "p"), geom="shape").collect()} == {(2, 1), (None, None)}
    got = sources.attach(df, spark.createDataFrame([(1, 9.0, "z")], "fid long, score double, name string")).orderBy("fid").collect()
    assert [(r["score"], r["name"], r["n"]) for r in got] == [(9.0, "z", None), (None, None, 4)]


def test_shapes(spark):
    df = spark.createDataFrame([(1e6, 2.0, 3.0, 1.0, 30.0)], "cx double, cy double, a double, b double, t double")
    r = df.select(geometry.circle(F.col("cx"), F.col("cy"), F.col("a")).alias("c"), geometry.ellipse(F.col("cx"), F.col("cy"), F.col("a"), F.col("b"), F.col("t")).alias("e"), geometry.line(F.col("cx"), F.col("cy"), F.col("a"), F.lit(90.0)).alias("l"))
    pts = r.select(*(geometry.rings(F.col(k))[0].alias(k) for k in "cel"), geometry.centroid(F.col("e")).alias("m")).first()
    assert len(pts["c"]) == 73 and all(math.hypot(p["x"] - 1e6, p["y"] - 2) == pytest.approx(3, abs=1e-8) for p in pts["c"])
    assert (pts["e"][0]["x"], pts["e"][0]["y"]) == (pytest.approx(1e6 + 3 * math.cos(math.pi / 6)), pytest.approx(2 + 1.5))
    assert (pts["m"]["x"], pts["m"]["y"]) == (pytest.approx(1e6), pytest.approx(2)) and pts["l"][0]["x"] == pytest.approx(1e6 - 1.5)


def test_charts(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 2, 4, 8])] + [(9, None)], "fid long, v double")
    h = charts.histogram(df, "v", 7).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 1, 0, 1, 0, 0, 1] and h[0]["low"] == 1 and h[-1]["high"] == 8
    assert [(r["share"], r["cumulative"]) for r in charts.lorenz(df, "v").collect()] == [(0, 0), (0.2, 1 / 16), (0.4, 2 / 16), (0.6, 4 / 16), (0.8, 8 / 16), (1, 1)]
    assert charts.quantile_breaks(df, "v", 2) == [2, 8] and len(charts.sigma_breaks(df, "v")) == 6
    assert [r["stratum"] for r in charts.quantile_bins(df, "v", 4).orderBy("fid").collect()] == [0, 0, 0, 1, 2, None]
    assert charts.histogram(df.limit(0), "v").count() == 0


def test_streaming_centre(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, 0, m), float(m), 1.0, 1.0 + m % 2) for m in range(20)]
    spark.createDataFrame(rows, "at timestamp, x double, y double, w double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, x double, y double, w double").parquet(str(tmp_path / "in"))
    out = streaming.windowed_mean_center(stream, "at", "10 minutes", "5 minutes")
    q = out.writeStream.format("memory").queryName("centres").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("centres").orderBy("window").collect()
    w = [1.0 + m % 2 for m in range(10)]
    assert len(got) == 2 and got[0]["mean_x"] == pytest.approx(sum(m * k for m, k in enumerate(w)) / sum(w)) and got[0]["mean_y"] == 1
