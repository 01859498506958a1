"""Small layers whose statistics are known."""

import math

import numpy as np
import pytest

from isopleth.functions import dist
from isopleth.layer import Statement
from isopleth.operators import audits, local, models, pattern, permuted
from isopleth.plans import neighbours


def chain(spark, values, ids=None):
    ids = ids or list(range(len(values)))
    edges = [(ids[i], ids[j]) for i in range(len(ids)) for j in (i - 1, i + 1) if 0 <= j < len(ids)]
    nodes = spark.createDataFrame([(i, float(v), float(v), 0) for i, v in zip(ids, values)], "fid long, v1 double, v2 double, cat int")
    return nodes, neighbours.row_standardised(spark.createDataFrame(edges, "src long, dst long"))


def test_moran_of_a_constant(spark):
    v, e = chain(spark, [5, 5, 5, 5])
    r = pattern.moran("pts", "v1", "knn").run(spark, {"pts": v, "knn": e}).first()
    assert (r["moran_i"], r["expected"], r["variance"], r["z_score"], r["p_value"]) == (0, pytest.approx(-1 / 3, abs=1e-8), 0, 0, pytest.approx(1))


def test_gini(spark):
    v, e = chain(spark, [1, 2, 4, 8])
    r = permuted.spatial_gini(v, e, "v1", 19).first()
    assert [r[k] for k in ("gini", "neighbour_part", "other_part", "spatial_gini")] == pytest.approx([23 / 60, 7 / 60, 16 / 60, 16 / 23], abs=1e-8)
    assert r["polarization"] == pytest.approx(16 / 7, abs=1e-6) and 0 < r["p_value"] <= 1
    zero = permuted.spatial_gini(*chain(spark, [0, 0, 0]), "v1", 19).first()
    assert zero["gini"] == zero["spatial_gini"] == 0 and zero["p_value"] is None
    with pytest.raises(ValueError, match="negative"):
        permuted.spatial_gini(*chain(spark, [-1, 2, 3]), "v1", 19)


def test_general_g_of_any_ids(spark):
    v, e = chain(spark, [1, 2, 4, 8], [10, 20, 50, 90])
    body = pattern._GENERAL_G.replace("v1 - (SELECT min(v1) FROM {pts})", "v1")
    r = Statement(body, ("pts", "band")).run(spark, {"pts": v, "band": e}).first()
    assert (r["general_g"], r["expected"]) == (pytest.approx(0.6), pytest.approx(0.5)) and 0 <= r["p_value"] <= 1


def test_ripley(spark):
    pts = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate((0.0, 1.0, 2.0, 5.0))], "fid long, x double, y double")
    body = pattern._RIPLEY.replace("greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-12D)", "10D")
    rows = Statement(body, ("pts", "band", "bands")).run(spark, {"pts": pts, "band": neighbours.within(pts, 3.0), "bands": spark.range(1, 4).selectExpr("CAST(id AS DOUBLE) AS d")}).orderBy("distance").collect()
    assert [r["pairs"] for r in rows] == [4, 6, 8]
    assert [r["k"] for r in rows] == pytest.approx([10 / 3, 5, 20 / 3]) and [r["l_minus_d"] for r in rows] == pytest.approx([0.0300645, -0.7384337, -1.5432688], abs=1e-6)


def test_lee(spark):
    v, e = chain(spark, [1, 2, 3, 4])
    rows = Statement(local._LEE, ("pts", "knn")).run(spark, {"pts": v, "knn": e}).orderBy("fid").collect()
    assert [r["lee_l"] for r in rows] == pytest.approx([0.6, 0.2, 0.2, 0.6])
    assert permuted.global_lee_l(v, e, "v1", "v2", 19).first()["statistic"] == pytest.approx(0.4)


def test_geary_gi_and_lisa(spark):
    v, e = chain(spark, [1, 2, 4, 8])
    assert permuted.geary_c(v, e, "v1", 19).first()["statistic"] == pytest.approx(0.3847826086956522, abs=1e-8)
    gi = Statement(local._GI, ("pts", "knn")).run(spark, {"pts": v, "knn": e}).orderBy("fid").collect()
    assert [r["gi_zscore"] for r in gi] == pytest.approx([-1.453631, -1.585258, 1.025755, 1.453631], abs=1e-6)
    lisa = Statement(local._LISA, ("pts", "knn")).run(spark, {"pts": v, "knn": e}).orderBy("fid").collect()
    assert [r["lisa_i"] for r in lisa] == pytest.approx([0.669565, 0.304348, 0.043478, 0.147826], abs=1e-6)
    assert sum(r["lisa_i"] for r in lisa) / 4 == pytest.approx(0.29130434782608694, abs=1e-6)


def test_join_counts(spark):
    v, e = chain(spark, [1, 1, 0, 0, 1, 0])
    rows = {r["kind"]: r["observed"] for r in permuted.join_counts(v, e, "v1", 19, category=1.0).collect()}
    assert rows == {"BB": 1, "WW": 1, "BW": 3}
    assert {r["kind"]: r["observed"] for r in permuted.join_counts(*chain(spark, [1, 2, 3, 4, 5, 6]), "v1", 19).collect()} == {"BB": 1, "WW": 3, "BW": 1}


def test_permutations_deal_all_values(spark):
    from isopleth.plans.permute import dealt

    v = spark.createDataFrame([(i * 7, float(i)) for i in range(30)], "fid long, v double")
    rows = dealt(v, 9).orderBy("fid").collect()
    pv = np.array([r["pv"] for r in rows])
    assert pv[:, 0].tolist() == list(range(30)) and all(sorted(pv[:, i]) == list(range(30)) for i in range(10)) and len({tuple(c) for c in pv.T}) == 10


def test_weights(spark):
    nodes = spark.createDataFrame([(i,) for i in (10, 20, 30, 40, 50, 90)], "fid long")
    edges = spark.createDataFrame([(20, 30), (30, 20), (40, 50), (50, 40)], "src long, dst long")
    s = audits.neighbour_summary(edges, nodes).first()
    assert (s["minimum"], s["maximum"], s["isolated"], s["density"]) == (0, 1, 2, "sparse, with isolated features")
    e = spark.createDataFrame([(10, 20), (10, 30), (20, 10), (20, 30), (20, 40), (40, 20)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["w"] for r in neighbours.restricted(e, spark.createDataFrame([(10,), (20,), (40,)], "fid long")).collect()}
    assert got == {(10, 20): 1.0, (20, 10): 0.5, (20, 40): 0.5, (40, 20): 1.0}


def test_contiguity_of_polygons(spark):
    square = "POLYGON (({0} {1}, {2} {1}, {2} {3}, {0} {3}, {0} {1}))"
    rows = [(1, square.format(0, 0, 1, 1)), (2, square.format(1, 0, 2, 1)), (3, square.format(1, 1, 2, 2)), (4, square.format(0.25, 1, 0.75, 2)), (5, square.format(9, 9, 10, 10)), (6, None), (7, "MULTIPOLYGON (((20 20, 21 20, 21 21, 20 20)), ((10 9, 11 9, 11 9.5, 10 9.5, 10 9)))")]
    df = spark.createDataFrame(rows, "fid long, geom string")
    queen = {(r["src"], r["dst"]) for r in neighbours.contiguity(df).collect()}
    rook = {(r["src"], r["dst"]) for r in neighbours.contiguity(df, False).collect()}
    both = lambda pairs: {p for a, b in pairs for p in ((a, b), (b, a))}
    assert queen == both([(1, 2), (1, 3), (2, 3), (1, 4), (5, 7)]) and rook == both([(1, 2), (2, 3), (1, 4), (5, 7)])


def test_scores_of_models():
    rows = [{"name": "patterned", "rmse": 1.0, "mae": 1.0, "coverage": 1.0, "p_value": 0.01}, {"name": "clean", "rmse": 1.15, "mae": 1.1, "coverage": 1.0, "p_value": 0.62}, {"name": "unknown", "rmse": 1.05, "mae": 1.05, "coverage": 0.9, "p_value": None}]
    got = {r["name"]: r for r in audits.scored(rows)}
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3] and got["clean"]["rank"] == 1 and got["clean"]["recommended"]
    assert got["patterned"]["score"] == pytest.approx(0.45 / 1.15 + 0.25 / 1.1 + 0.35) and not got["patterned"]["recommended"]


def test_class_summaries(spark):
    gi = audits.class_summary(spark.createDataFrame([(x,) for x in (-3, -2, 0, 1, 2, 3, 3, None)], "c int"), "c").first()
    assert (gi["hot"], gi["cold"], gi["significant"], gi["dominant"]) == (4, 2, 6, "99% hot spot")
    lisa = audits.class_summary(spark.createDataFrame([(x,) for x in ("HH", "HH", "LL", "HL", "LH", None)], "c string"), "c", "lisa").first()
    assert (lisa["clusters"], lisa["outliers"], lisa["significant"], lisa["dominant"]) == (3, 2, 5, "high-high cluster")


def test_readings(spark):
    graph = spark.createDataFrame([(0, False, "usable"), (2, False, "sparse, with isolated features")], "isolated int, all_connected boolean, density string")
    moran = spark.createDataFrame([(3.2, 0.001, "x")], "z_score double, p_value double, pattern string")
    a, b = (audits.moran_reading(moran, graph.filter(f"isolated = {i}")).first() for i in (0, 2))
    assert (a["pattern"], a["evidence"]) == ("clustered", "very strong") and "local" in a["next_action"] and "widen" in b["next_action"]
    down = audits.moran_reading(spark.createDataFrame([(-2.5, 0.02, "x")], "z_score double, p_value double, pattern string"), graph.filter("isolated = 0")).first()
    assert (down["pattern"], down["evidence"]) == ("dispersed", "strong")
    ok = audits.sensitivity_reading(spark.createDataFrame([(0.01,)], "p_value double"), graph.filter("isolated = 0")).first()
    bad = audits.sensitivity_reading(spark.createDataFrame([(0.4,)], "p_value double"), graph.filter("isolated = 2")).first()
    assert (ok["verdict"], ok["cautions"]) == ("robust", []) and bad["verdict"] == "sensitive" and "isolated features" in bad["cautions"]


def test_advice():
    assert "poisson" in audits.advise(4, 2, 3, True)[1][1] and not audits.advise(4, 2, 3, True)[2]
    assert "getis_ord_gi" in audits.advise(1, 1, 1, False)[1] and audits.advise(1, 1, 1, False)[2]
    assert audits.advise(0, 0, 0, False)[1] == ["data_readiness_audit", "average_nearest_neighbor", "ripleys_k_function"]


def test_tails(spark):
    assert dist.chi2_tail(4.2, 2) == pytest.approx(math.exp(-2.1))
    row = spark.sql("SELECT " + ", ".join(f"{dist.chi2_sf(f'{x!r}D', k)} AS c{i}" for i, (x, k) in enumerate([(4.2, 2), (3.0, 5), (11.0, 5)]))).first()
    assert list(row) == pytest.approx([math.exp(-2.1), 0.7, 0.0514], abs=3e-3)
    assert spark.sql(f"SELECT {dist.chi2_sf1('3.841459D')} AS p").first()[0] == pytest.approx(0.05, abs=1e-6)
    xs = (0.5, 1.0, 2.5, 7.0, 100.0, 1e6)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(dist.lgamma(df.x)).collect()] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)


def test_readiness(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), 7.0, None if i == 3 else float("inf") if i == 4 else float(i)) for i in range(10)], "y double, b double, c double, m double")
    got = {r["field"]: r for r in audits.readiness(df, ["y", "b", "c", "m"]).collect()}
    assert (got["y"]["readiness"], got["c"]["readiness"], got["m"]["readiness"]) == ("ready", "constant", "missing values")
    assert got["m"]["missing"] == 2 and got["m"]["non_finite"] == 1 and got["y"]["median"] == 4.5 and "logistic" in got["b"]["families"]
    corr = {(r["a"], r["b"]): r["r"] for r in audits.correlations(df, ["y", "m", "b"]).collect()}
    assert corr["y", "m"] == pytest.approx(1.0)
    twin = df.selectExpr("y AS x1", "2 * y AS x2", "b AS x3")
    v = {r["field"]: r for r in audits.collinearity(twin, ["x1", "x2", "x3"]).collect()}
    assert v["x1"]["status"] == "high" and v["x1"]["ill_conditioned"]


def test_comparison_of_outputs(spark):
    y = spark.createDataFrame([(i, float(v)) for i, v in enumerate((10, 12, 14, 16))], "fid long, y double")
    ols = spark.createDataFrame([(i, float(r), 0.0) for i, r in enumerate((1, -1, -1, 1))], "fid long, residual double, std_res double")
    glr = spark.createDataFrame([(0, 9.0, 1.0, 1), (1, 12.0, 0.0, 1), (2, None, None, 0)], "fid long, glr_fit double, glr_resid double, glr_used int")
    got = {r["name"]: r for r in audits.compare_models({"a": ols, "b": glr}, y, None).collect()}
    assert (got["a"]["rmse"], got["a"]["mae"], got["a"]["bias"], got["a"]["family"]) == (1, 1, 0, "ols")
    assert (got["b"]["n"], got["b"]["coverage"], got["b"]["family"]) == (2, 0.5, "glr")
    with pytest.raises(ValueError):
        audits.family_of(["fid", "other"])


def test_glr_families(spark):
    def fit(ys, family):
        return spark.createDataFrame([(i, float(i), float(y)) for i, y in enumerate(ys)], "fid long, x double, y double"), family

    for ys, family in (([1, 2, 2.8, 4.2, 5.1, 5.9], "gaussian"), ([0, 0, 1, 0, 1, 1], "logistic"), ([0, 1, 1, 3, 5, 8], "poisson")):
        df, family = fit(ys, family)
        out = [r["glr_fit"] for r in models.glr_output(df, "y", ["x"], family).orderBy("fid").collect()]
        r = models.glr_report(df, "y", ["x"], family).first()
        assert r["converged"] and len(out) == 6
        if family == "logistic":
            assert all(0 <= v <= 1 for v in out) and r["log_likelihood"] == pytest.approx(sum(y * math.log(v) + (1 - y) * math.log(1 - v) for y, v in zip(ys, out)))
        if family == "poisson":
            assert r["log_likelihood"] == pytest.approx(sum(y * math.log(v) - v - math.lgamma(y + 1) for y, v in zip(ys, out)), abs=1e-9)
        if family == "gaussian":
            assert out == pytest.approx(list(np.polyval(np.polyfit(range(6), ys, 1), range(6))))
