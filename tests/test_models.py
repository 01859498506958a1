"""Regressions against dense algebra."""

import math

import numpy as np
import pytest

from isopleth.layer import Statement
from isopleth.operators import models
from isopleth.plans import neighbours, spectrum
from isopleth.plans.store import stored


def layer(spark, n=60, seed=1, shift=0.0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 10, (n, 2))
    x = rng.normal(size=(n, 2)) + shift
    y = 1 + 2 * x[:, 0] - x[:, 1] * (1 + xy[:, 0] / 10) + rng.normal(size=n) * 0.3
    rows = [(int(i * 3), float(a), float(b), float(p), float(q), float(t), "ab"[i % 2]) for i, ((a, b), (p, q), t) in enumerate(zip(xy, x, y))]
    return spark.createDataFrame(rows, "fid long, x double, y double, x1 double, x2 double, t double, g string"), xy, x, y


def design(x):
    return np.column_stack([np.ones(len(x)), x])


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_ols(spark, shift):
    df, _, x, y = layer(spark, shift=shift)
    fit = models.ols(df, "t", ["x1", "x2"])
    z = design(x - shift)
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    s2 = e @ e / (len(y) - 3)
    assert fit["beta"][1:] == pytest.approx(b[1:], rel=1e-6) and fit["rss"] == pytest.approx(e @ e, rel=1e-5)
    assert fit["se"][1:] == pytest.approx(np.sqrt(s2 * np.diag(np.linalg.inv(z.T @ z)))[1:], rel=1e-5)
    assert fit["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())), abs=1e-8)


def test_ols_report_and_output(spark):
    df, _, x, y = layer(spark)
    edges = neighbours.row_standardised(neighbours.nearest(df, 4))
    z, n = design(x), len(y)
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    r = models.ols_report(df, "t", ["x1", "x2"], edges).first()
    v = e @ e / n
    jb = n / 6 * (((e**3).mean() / v**1.5) ** 2 + 0.25 * ((e**4).mean() / v**2 - 3) ** 2)
    g = e * e
    h = g - z @ np.linalg.lstsq(z, g, rcond=None)[0]
    assert r["jarque_bera"] == pytest.approx(jb) and r["breusch_pagan"] == pytest.approx(n * (1 - h @ h / ((g - g.mean()) @ (g - g.mean()))))
    w = np.zeros((n, n))
    for q in edges.collect():
        w[q["src"] // 3, q["dst"] // 3] = q["w"]
    assert r["residual_moran"] == pytest.approx(e @ w @ e / (e @ e))
    out = models.ols_output(df.unionByName(df.limit(1).selectExpr("fid + 1 AS fid", "x", "y", "CAST('inf' AS DOUBLE) AS x1", "x2", "t", "g")), "t", ["x1", "x2"]).orderBy("fid").collect()
    assert len(out) == n + 1 and sum(q["residual"] is None for q in out) == 1
    assert [q["residual"] for q in out if q["residual"] is not None] == pytest.approx(list(e))


def test_exploratory(spark):
    df, _, x, y = layer(spark)
    rows = {r["variables"]: r for r in models.exploratory(df, "t", ["x1", "x2"]).collect()}
    assert set(rows) == {"x1", "x2", "x1,x2"}
    assert rows["x1,x2"]["r2"] == pytest.approx(models.ols(df, "t", ["x1", "x2"])["r2"]) and rows["x1"]["max_vif"] == pytest.approx(1)
    assert rows["x1,x2"]["max_vif"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2))


def brute_gwr(xy, x, y, w):
    z, out = design(x), []
    for i in range(len(y)):
        k = w(np.sqrt(((xy - xy[i]) ** 2).sum(axis=1)))
        inv = np.linalg.pinv(z.T * k @ z)
        b = inv @ (z.T * k) @ y
        e = y - z @ b
        s2 = (k * e * e).sum() / (k.sum() - 3)
        m = (k * y).sum() / k.sum()
        out.append((z[i] @ b, *b, *np.sqrt(np.maximum(0, s2 * np.diag(inv))), 1 - (k * e * e).sum() / (k * (y - m) ** 2).sum(), int((k > 1e-12).sum()), z[i] @ inv @ z[i]))
    return np.array(out)


@pytest.mark.parametrize(("kernel", "bandwidth"), [("adaptive_bisquare", 25), ("fixed_bisquare", 6.0), ("fixed_gaussian", 2.0)])
def test_gwr(spark, kernel, bandwidth):
    df, xy, x, y = layer(spark)

    def weight(d):
        if kernel == "fixed_gaussian":
            return np.exp(-0.5 * (d / bandwidth) ** 2)
        b = np.sort(d)[bandwidth - 1] if kernel == "adaptive_bisquare" else bandwidth
        return np.where(d < b, (1 - (d / b) ** 2) ** 2, 0.0)

    rows = models.gwr(df, "t", ["x1", "x2"], bandwidth, kernel).orderBy("fid").collect()
    want = brute_gwr(xy, x, y, weight)
    names = ["y_predicted", "coef_int", "coef_x1", "coef_x2", "se_int", "se_x1", "se_x2", "local_r2", "support", "hat"]
    got = np.array([[r[c] for c in names] for r in rows], dtype=float)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-8)
    rep = models.gwr_report(models.gwr(df, "t", ["x1", "x2"], bandwidth, kernel)).first()
    n, tr, rss = len(y), want[:, -1].sum(), ((y - want[:, 0]) ** 2).sum()
    assert rep["aicc"] == pytest.approx(n * math.log(rss / n) + n * math.log(2 * math.pi) + n * (n + tr) / (n - 2 - tr))


def test_mgwr_is_gwr_like_with_one_bandwidth(spark):
    df, xy, x, y = layer(spark, 80)
    out, chosen = models.mgwr(df, "t", ["x1", "x2"], candidates=(80,), steps=40, tolerance=1e-6)
    rows = out.orderBy("fid").collect()
    # backfitting done densely
    s = lambda v: (v - v.mean(axis=0)) / v.std(axis=0)
    z, t = np.column_stack([np.ones(80), s(x)]), s(y)
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(axis=2))
    b = np.sort(d, axis=1)[:, 79]
    k = np.where(d < b[:, None], (1 - (d / b[:, None]) ** 2) ** 2, 0.0)
    f = z * np.linalg.lstsq(z, t, rcond=None)[0]
    for _ in range(40):
        for j in range(3):
            r = t - f.sum(axis=1) + f[:, j]
            f[:, j] = z[:, j] * (k @ (z[:, j] * r)) / (k @ (z[:, j] ** 2))
    assert set(chosen.values()) == {80} and np.allclose([r["mgwr_pred"] for r in rows], f.sum(axis=1) * y.std() + y.mean(), atol=1e-3)


def dense(edges, n):
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r["src"] // 3, r["dst"] // 3] = r["w"]
    return w


def test_spatial_models(spark):
    df, xy, x, y = layer(spark, 50)
    edges = neighbours.row_standardised(neighbours.nearest(df, 5))
    w, z, n = dense(edges, 50), design(x), 50

    def loss(p, kind):
        a = np.eye(n) - p * w
        t, u = (a @ y, z) if kind == "lag" else (a @ y, a @ z)
        e = t - u @ np.linalg.lstsq(u, t, rcond=None)[0]
        return n / 2 * math.log(e @ e / n) - np.linalg.slogdet(a)[1]

    for kind, name in (("lag", "rho"), ("error", "lambda")):
        got = {r["term"]: r["estimate"] for r in models.spatial_ml(df, edges, "t", ["x1", "x2"], kind).collect()}
        best = min((p / 1000 for p in range(-990, 991)), key=lambda p: loss(p, kind))
        assert got[name] == pytest.approx(best, abs=2e-3)
    exact, rough = (models._log_determinant(edges, df.select("fid"), n, most, powers=10, vectors=60) for most in (5_000, 1))
    assert rough(0.5) == pytest.approx(exact(0.5), abs=0.6) and rough(-0.3) == pytest.approx(exact(-0.3), abs=0.6)


def test_lm_and_durbin(spark):
    df, _, x, y = layer(spark, 50)
    edges = neighbours.row_standardised(neighbours.nearest(df, 5))
    w, z, n = dense(edges, 50), design(x), 50
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    s2, t = e @ e / n, np.trace(w.T @ w + w @ w)
    wf = w @ z @ b
    d = (wf @ (np.eye(n) - z @ np.linalg.pinv(z)) @ wf) / s2 + t
    got = {r["test"]: r["statistic"] for r in models.lm_diagnostics(df, edges, "t", ["x1", "x2"]).collect()}
    dl, de = e @ w @ y / s2, e @ w @ e / s2
    assert got["LM-lag"] == pytest.approx(dl**2 / d) and got["LM-error"] == pytest.approx(de**2 / t)
    assert got["Robust LM-lag"] == pytest.approx((dl - de) ** 2 / (d - t)) and got["SARMA"] == pytest.approx(de**2 / t + (dl - de) ** 2 / (d - t))
    wx = w @ x
    q = np.column_stack([z, wx, w @ y])
    h = np.column_stack([z, wx, w @ wx])
    p = h @ np.linalg.pinv(h)
    beta = np.linalg.solve(q.T @ p @ q, q.T @ p @ y)
    assert [r["estimate"] for r in models.durbin(df, edges, "t", ["x1", "x2"]).collect()] == pytest.approx(list(beta), rel=1e-5)


def test_esf(spark):
    df, xy, x, y = layer(spark, 50)
    edges = neighbours.row_standardised(neighbours.nearest(df, 5))
    rows = models.esf(df, edges, "t", ["x1", "x2"]).orderBy("fid").collect()
    assert np.allclose([r["residual"] + r["fitted"] for r in rows], y)
    e = np.array([r["residual"] for r in rows])
    assert abs(design(x).T @ e).max() < 1e-8 and e @ e <= models.ols(df, "t", ["x1", "x2"])["rss"] + 1e-9
    with pytest.raises(ValueError):
        models.esf(df, edges, "t", ["x1"], most=10)


def test_esf_without_a_dense_matrix(spark):
    rng = np.random.default_rng(3)
    xy, x = rng.uniform(0, 10, (300, 2)), rng.normal(size=(300, 2))
    y = x[:, 0] + np.sin(xy[:, 0]) + np.cos(xy[:, 1]) + rng.normal(size=300) * 0.2
    df = spark.createDataFrame([(i * 3, *map(float, (a, b, p, q, t))) for i, ((a, b), (p, q), t) in enumerate(zip(xy, x, y))], "fid long, x double, y double, x1 double, x2 double, t double")
    edges = neighbours.row_standardised(neighbours.nearest(df, 5))
    # by the definition, from a dense matrix
    w, z, picked = dense(edges, 300), design(x), []
    c = np.eye(300) - 1 / 300
    value, vector = np.linalg.eigh(c @ ((w + w.T) / 2) @ c)
    pool = list(np.flatnonzero(value > 1e-10))
    for _ in range(4):
        full = np.column_stack([z, vector[:, picked]])
        e = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
        picked.append(max((j for j in pool if j not in picked), key=lambda j: abs(vector[:, j] @ (e - e.mean()))))
    full = np.column_stack([z, vector[:, picked]])
    e = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    for most in (0, 5_000):
        got = models.esf(df, edges, "t", ["x1", "x2"], most_vectors=4, dense=most).orderBy("fid").collect()
        assert np.allclose([r["residual"] for r in got], e, atol=1e-7) and np.std([r["spatial_filter"] for r in got]) > 0.1


def noise(spark, n, seed):
    """Points whose values have little of a pattern, so that shares of all eigenvectors are alike; links and the definition's choice of vectors."""
    rng = np.random.default_rng(seed)
    xy, x = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    y = x[:, 0] + np.sin(2 * xy[:, 0]) + np.cos(3 * xy[:, 1]) + rng.normal(size=n)
    df = spark.createDataFrame([(i * 3, *map(float, (a, b, p, q, t))) for i, ((a, b), (p, q), t) in enumerate(zip(xy, x, y))], "fid long, x double, y double, x1 double, x2 double, t double")
    edges = stored(neighbours.row_standardised(neighbours.nearest(df, 8)))
    c, w = np.eye(n) - 1 / n, dense(edges, n)
    return df, edges, design(x), y, np.linalg.eigh(c @ ((w + w.T) / 2) @ c)


def left(z, y):
    return y - z @ np.linalg.lstsq(z, y, rcond=None)[0]


def test_esf_steps_run_outside_python(spark, monkeypatch):
    """51,282 features take some 100,000 steps and as many in the second pass: one product each in numpy took too long."""
    df, edges, z, y, (value, vector) = noise(spark, 900, 5)
    picked, calls, product = [], [], spectrum.Centred.__call__
    for _ in range(4):
        e = left(np.column_stack([z, vector[:, picked]]), y)
        picked.append(max((j for j in np.flatnonzero(value > 1e-10) if j not in picked), key=lambda j: abs(vector[:, j] @ e)))
    monkeypatch.setattr(spectrum.Centred, "__call__", lambda self, x: calls.append(1) or product(self, x))
    got = [r["residual"] for r in models.esf(df, edges, "t", ["x1", "x2"], most_vectors=4, dense=0).orderBy("fid").collect()]
    assert np.allclose(got, left(np.column_stack([z, vector[:, picked]]), y), atol=1e-7)
    assert len(calls) < 900


def test_no_unknown_eigenvector_exceeds_the_bound(spark):
    df, edges, z, y, (value, vector) = noise(spark, 700, 6)
    links, e = edges.toPandas(), left(z, y)
    found = spectrum.Leading(spark, spectrum.Centred(700, links["src"].to_numpy() // 3, links["dst"].to_numpy() // 3, links["w"].to_numpy()), e, z, 5)
    known = np.abs(vector.T @ found.vectors).max(1) > 0.999
    others = np.abs(vector.T @ e)[(value > 1e-10) & ~known]
    assert known.sum() == found.vectors.shape[1] >= 5 and others.max() <= found.bound < 1.1 * others.max()
    u, reach = found._reach
    assert u.shape[1] == 2 and (np.abs(vector[:, value > 1e-10].T @ u).max(0) <= reach).all()


def test_esf_takes_no_eigenvector_of_value_zero(spark):
    # opposite values on two leaves of a star: a large share with eigenvalue 0, beside a smooth pattern along a line of hubs
    n, rng = 360, np.random.default_rng(2)
    hub, links = np.arange(120), []
    for i in range(120):
        links += [*((i, j) for j in (i - 1, i + 1) if 0 <= j < 120), *((i, j) for j in (120 + i, 240 + i)), *((j, i) for j in (120 + i, 240 + i))]
    smooth = np.cos(np.pi * hub / 120)
    t = np.concatenate([smooth, smooth + 2, smooth - 2]) + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, float(v), float(u)) for i, (v, u) in enumerate(zip(t, rng.normal(size=n)))], "fid long, t double, x1 double")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, w double")
    want, got = ([r["residual"] for r in models.esf(df, edges, "t", ["x1"], most_vectors=1, dense=d).orderBy("fid").collect()] for d in (5_000, 0))
    assert np.std(want) > 1 and np.allclose(got, want, atol=1e-6)


def test_esf_takes_more_features_than_a_dense_matrix_holds(spark):
    grid = [(i, float(i % 80), float(i // 80)) for i in range(5_040)]
    df = spark.createDataFrame([(i, a, b, math.sin(i * 1.7), a / 40 + math.cos(i * i * 0.3)) for i, a, b in grid], "fid long, x double, y double, x1 double, t double")
    at = {(a, b): i for i, a, b in grid}
    links = [(i, at[a + p, b + q]) for i, a, b in grid for p, q in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (a + p, b + q) in at]
    rows = models.esf(df, spark.createDataFrame(links, "src long, dst long"), "t", ["x1"], most_vectors=1).orderBy("fid").collect()
    e = np.array([r["residual"] for r in rows])
    t = np.array([a / 40 + math.cos(i * i * 0.3) for i, a, _ in grid])
    z = np.column_stack([np.ones(5_040), [math.sin(i * 1.7) for i in range(5_040)]])
    assert len(rows) == 5_040 and abs(z.T @ e).max() < 1e-6
    # the trend along x is one smooth pattern, which takes most of what it explains
    before = t - z @ np.linalg.lstsq(z, t, rcond=None)[0]
    assert e @ e < 0.75 * (before @ before)


def test_regimes(spark):
    df, _, x, y = layer(spark, 60)
    rows = models.regimes(df, "t", ["x1"], "g").collect()
    for k, g in enumerate("ab"):
        z = design(x[k::2, :1])
        assert [r["estimate"] for r in rows if r["regime"] == g] == pytest.approx(list(np.linalg.lstsq(z, y[k::2], rcond=None)[0]))
    with pytest.raises(ValueError):
        models.regimes(df.filter("g = 'a'"), "t", ["x1"], "g")


def test_quantile_against_enumeration(spark):
    df, _, x, y = layer(spark, 21)
    got = [r["estimate"] for r in models.quantile(df, "t", ["x1"], 0.25, steps=400).collect()]

    def loss(a, b):
        r = y - a - b * x[:, 0]
        return np.where(r >= 0, 0.25 * r, -0.75 * r).sum()

    # an optimal line goes through two of the points
    best = min(loss(y[i] - (y[j] - y[i]) / (x[j, 0] - x[i, 0]) * x[i, 0], (y[j] - y[i]) / (x[j, 0] - x[i, 0])) for i in range(21) for j in range(i))
    assert loss(*got) == pytest.approx(best, rel=2e-3)


def test_audit_from_counted_values(spark):
    rng = np.random.default_rng(5)
    values = [*np.round(rng.normal(size=150) * 3, 1).tolist(), 90.0, None, None]
    for part in (values, [2.0, 3.0, None], [4.0, 1.0, 1.0, 7.0]):
        df = spark.createDataFrame([(v,) for v in part], "y double")
        want = Statement(models._AUDIT, ("reg",)).run(spark, {"reg": df}).first().asDict()
        assert models.audit(df).first().asDict() == {k: pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for k, v in want.items()}
        plan = models.audit(df)._jdf.queryExecution().toString()
        assert "percentile" not in plan and "distinct y" not in plan.lower()
