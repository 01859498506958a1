import math

import pytest

from isopleth.functions import dist
from isopleth.operators import centres, models, pattern
from isopleth.plans import neighbours


def chain(spark, ys):
    n = len(ys)
    edges = [(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    return spark.createDataFrame([(i, float(y)) for i, y in enumerate(ys)], "fid long, v1 double"), neighbours.row_standardised(spark.createDataFrame(edges, "src long, dst long"))


def test_erfc(spark):
    xs = (0.0, 0.1, 0.46, 0.5, 1.0, 2.5, 3.9, 4.1, 6.0)
    row = spark.sql("SELECT " + ", ".join(f"{dist.erfc(f'{x!r}D')} AS c{i}" for i, x in enumerate(xs))).first()
    assert all(abs(row[i] - math.erfc(x)) < 1e-15 for i, x in enumerate(xs))


def test_moran_of_a_chain(spark):
    v, e = chain(spark, [1, 2, 4, 8])
    r = pattern.moran("pts", "v1", "knn").run(spark, {"pts": v, "knn": e}).first()
    assert r["moran_i"] == pytest.approx(0.29130434782608694, abs=1e-8)
    assert r["variance"] == pytest.approx(0.1448624238605335, abs=1e-9)
    assert r["z_score"] == pytest.approx(1.641157665605773, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.10076469098579569, abs=1e-7)


@pytest.mark.parametrize("leaf", [2048, 16])
def test_nearest_against_all_pairs(spark, leaf):
    import random

    rng = random.Random(1)
    pts = [(i, rng.random() ** 3, rng.random()) for i in range(120)] + [(200 + i, 0.5, 0.5) for i in range(30)] + [(300 + i, 7 + rng.random() * 1e-4, 7.0) for i in range(40)] + [(400, 1e6, -1e6)]
    df = spark.createDataFrame(pts, "fid long, x double, y double")
    got = {(r["src"], r["r"]): r["dst"] for r in neighbours.nearest(df, 4, leaf).collect()}
    assert len(got) == 4 * len(pts)
    for f, x, y in pts:
        want = sorted(((a - x) * (a - x) + (b - y) * (b - y), g) for g, a, b in pts if g != f)[:4]
        assert [got[f, i + 1] for i in range(4)] == [g for _, g in want]


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(5, 0.0, 0.0), (9, 3.0, 4.0), (7, None, 1.0), (8, float("nan"), 1.0)], "fid long, x double, y double")
    assert sorted(map(tuple, neighbours.nearest(few, 4).collect())) == [(5, 9, 25.0, 1), (9, 5, 25.0, 1)]
    assert neighbours.nearest(few.filter("fid = 5"), 4).count() == 0 and neighbours.nearest(few.limit(0), 4).count() == 0


def test_within(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 2.0, 0.0), (3, 5.0, 0.0), (4, None, 0.0)], "fid long, x double, y double")
    assert {(r["src"], r["dst"]) for r in neighbours.within(df, 1.0).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    with pytest.raises(ValueError):
        neighbours.within(df, 0)


def test_ols_and_glr(spark):
    df = spark.createDataFrame([(float(i), float(2 + 3 * i)) for i in range(10)], "x double, y double")
    fit = models.ols(df, "y", ["x"])
    assert fit["beta"] == pytest.approx([2, 3]) and fit["r2"] == pytest.approx(1)
    bad = spark.createDataFrame([(1.0, 1.5), (2.0, 0.0), (3.0, 1.0)], "x double, y double")
    with pytest.raises(ValueError, match="binary"):
        models.glr(bad, "y", ["x"], "logistic")
    with pytest.raises(ValueError, match="count"):
        models.glr(bad, "y", ["x"], "poisson")


def test_quantile_takes_its_own_steps(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), float(2 + 3 * i + (40 if i % 5 == 0 else 0))) for i in range(40)], "x1 double, y double")
    got = models.quantile(df, "y", ["x1"], steps=2).collect()
    assert [(r["iterations"], r["converged"]) for r in got] == [(2, False)] * 2
    got = models.quantile(df, "y", ["x1"]).collect()
    assert [r["estimate"] for r in got] == pytest.approx([2, 3], abs=1e-3) and got[0]["converged"] and got[0]["iterations"] > 2
    seen = []
    monkeypatch.setattr(models, "reg", lambda s, d: None)
    monkeypatch.setattr(models, "quantile", lambda *a, **more: seen.append(more))
    models.QUERIES["quantile_regression"](spark, "")
    assert seen == [{}]


def test_median_center(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (0.0, 2.0, 1.0), (2.0, 2.0, 1.0)], "x double, y double, w double")
    r = centres.median_center(df).first()
    assert r["median_x"] == pytest.approx(1) and r["median_y"] == pytest.approx(1)
    with pytest.raises(ValueError):
        centres.median_center(df.withColumn("w", df.w * 0))


def test_statements_compile_for_other_engines():
    from isopleth import entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [k for k, v in entry.oracle_sql().items() if "{" in v]
