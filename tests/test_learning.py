"""Learning operators: against plain numpy where they are exact, else against what a good fit must reach."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.operators import explain, kernels, learning, regional, trees
from isopleth.plans import neighbours, stars
from isopleth.plans.ranks import ranked


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(5)
    n = 150
    xy = rng.uniform(0, 10, (n, 2))
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1] + rng.normal(size=n) * 0.1
    rows = [(int(i * 5), *map(float, xy[i]), *map(float, x[i]), float(y[i]), "pos" if y[i] > 0 else "neg", "abc"[min(2, int(abs(x[i, 1]) * 2))]) for i in range(n)]
    rows.append((9001, 1.0, 1.0, None, 0.0, 0.0, 1.0, "pos", "a"))
    return spark.createDataFrame(rows, "fid long, x double, y double, a double, b double, c double, t double, k string, m string"), xy, x, y


XS = ["a", "b", "c"]


def r2(df, pred, y):
    got = [r[pred] for r in df.filter("fid < 9000").orderBy("fid").collect()]
    return 1 - ((np.array(got) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_regressions(layer):
    df, _, _, y = layer
    for out, pred, used, least in (
        (learning.regression(df, "t", XS, trees=8, depth=6), "rf_pred", "rf_used", 0.9),
        (learning.regression(df, "t", XS, "gbt", "gbm", trees=8, depth=3), "gbm_pred", "gbm_used", 0.6),
        (trees.extra_trees_regression(df, "t", XS, trees=20, max_depth=6), "et_pred", "et_used", 0.85),
        (kernels.support_vector_regression(df, "t", XS), "svr_pred", "svr_used", 0.85),
        (kernels.support_vector_regression(df, "t", XS, "linear", steps=8), "svr_pred", "svr_used", 0.6),
        (kernels.mlp_regression(df, "t", XS, steps=300), "mlp_pred", "mlp_used", 0.8),
        (explain.ebm(df, "t", XS), "ebm_pred", "ebm_used", 0.9),
    ):
        assert r2(out, pred, y) > least, pred
        rows = out.collect()
        assert len(rows) == 151 and [r[used] for r in rows if r["fid"] == 9001] == [0]


def test_classifications(layer):
    df = layer[0]
    truth = {r["fid"]: (r["k"], r["m"]) for r in df.collect()}
    for out, name, at, least in (
        (learning.classification(df, "k", XS, trees=8, depth=6), "rf_class", 0, 0.95),
        (learning.classification(df, "m", XS, "mlp", "mlp", steps=200), "mlp_class", 1, 0.8),
        (trees.extra_trees_classification(df, "m", XS, trees=20, max_depth=6), "et_class", 1, 0.8),
        (kernels.support_vector_classification(df, "k", XS), "svc_class", 0, 0.9),
        (kernels.support_vector_classification(df, "m", XS, steps=15), "svc_class", 1, 0.7),
        (explain.ebm(df, "k", XS, "classification"), "ebm_class", 0, 0.9),
    ):
        rows = [r for r in out.collect() if r["fid"] != 9001]
        assert np.mean([r[name] == truth[r["fid"]][at] for r in rows]) > least, name
    with pytest.raises(ValueError):
        learning.classification(df.filter("k = 'pos'"), "k", XS)
    with pytest.raises(ValueError):
        explain.ebm(df, "m", XS, "classification")


def test_ebm_adds_up(layer):
    rows = explain.ebm(layer[0], "t", XS).filter("ebm_used = 1").collect()
    assert all(r["ebm_pred"] == pytest.approx(r["ebm_intercept"] + r["ebm_a"] + r["ebm_b"] + r["ebm_c"]) for r in rows)


def test_shapley_values(layer):
    df, _, x, _ = layer
    model, ready = learning.fit_regression(df, "t", XS, "rf", trees=4, depth=4)
    g = explain.parsed(model)
    pred = [r["prediction"] for r in model.transform(ready).orderBy("fid").collect()]
    assert g.predict(x)[:, 0] == pytest.approx(pred)
    cover = [c[:, 0] for c in explain.covers(ready, g, XS)]
    assert [c[0] for c in cover] == [150] * 4

    def expect(t, n, row, known):  # the definition, node by node
        j = g.feature[t][n]
        if j < 0:
            return g.value[t][n][0]
        left = g.child[t][n]
        if j in known:
            return expect(t, left + (row[j] > g.cut[t][n]), row, known)
        return sum(cover[t][c] / cover[t][n] * expect(t, c, row, known) for c in (left, left + 1))

    values = {r["fid"]: r for r in explain.shap_values(df, "t", XS, fitted=(model, ready)).collect()}
    assert values[9001]["shap_used"] == 0 and values[9001]["shap_a"] is None
    for i in (0, 7, 31):
        v = {s: np.mean([expect(t, 0, x[i], s) for t in range(4)]) for k in range(4) for s in itertools.combinations(range(3), k)}
        want = [sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (v[tuple(sorted((*s, j)))] - v[s]) for s in v if j not in s) for j in range(3)]
        r = values[i * 5]
        assert [r["shap_a"], r["shap_b"], r["shap_c"]] == pytest.approx(want) and r["shap_base"] + sum(want) == pytest.approx(r["shap_pred"])
    top = explain.shap_importance(explain.shap_values(df, "t", XS, trees=4), XS).first()
    assert top["field"] == "a"
    local = explain.shap_local(explain.shap_values(df, "t", XS, trees=4), XS, 35).collect()
    assert len(local) == 3 and local[0]["base"] + sum(r["contribution"] for r in local) == pytest.approx(local[0]["prediction"])
    shares = explain.shap_values(df, "k", XS, task="classification", class_label="pos", trees=4).filter("shap_used = 1").collect()
    assert all(0 <= r["shap_pred"] <= 1 for r in shares)


def test_boosted_trees_are_read_back(layer):
    model, ready = learning.fit_regression(layer[0], "t", XS, "gbt", trees=5, depth=3)
    g = explain.parsed(model)
    rows = model.transform(ready).orderBy("fid").collect()
    assert g.predict(layer[2])[:, 0] == pytest.approx([r["prediction"] for r in rows])


def test_counterfactuals(layer):
    df = layer[0]
    rows = explain.counterfactuals(df, "k", XS, 0, trees=10, immutable=("c",)).collect()
    own = df.filter("fid = 0").first()
    assert rows and all(r["c"] == own["c"] and r["changes"] >= 1 and r["class"] != own["k"] for r in rows)
    assert [r["changes"] for r in rows] == sorted(r["changes"] for r in rows)


def test_extra_trees_draw_rows_alike():
    ids = np.arange(20_000)
    w = trees.bootstrap(ids, 3, 1)
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.02
    assert (trees.bootstrap(ids[::-1], 3, 1)[::-1] == w).all() and (trees.bootstrap(ids, 4, 1) != w).any()


def test_uncertainty_conformal_and_importance(layer):
    df = layer[0]
    rows = learning.uncertainty(df, "t", XS, trees=10).filter("unc_pred is not null").collect()
    assert len(rows) == 150 and all(r["unc_low"] <= r["unc_pred"] + 1.5 and r["unc_low"] <= r["unc_high"] and r["unc_std"] >= 0 for r in rows)
    out = {r["fid"]: r for r in learning.conformal(df, "t", XS, trees=10).collect()}
    y = {r["fid"]: r["t"] for r in df.filter("a is not null").collect()}
    assert np.mean([out[i]["conf_low"] <= y[i] <= out[i]["conf_high"] for i in y]) >= 0.9
    imp = {r["field"]: r["importance"] for r in learning.permutation_importance(df, "t", XS, repeats=3, trees=10).collect()}
    assert imp["a"] > imp["c"] and imp["b"] > imp["c"]
    pd_ = learning.partial_dependence(df, "t", XS, "a", trees=10).collect()
    assert len(pd_) == 20 and pd_[-1]["mean_prediction"] > pd_[0]["mean_prediction"] + 1


def test_folds_and_leaderboard(layer):
    df = layer[0].filter("fid < 9000")
    folds = learning.matched_folds(df, 4, tries=30)
    sizes = [r["count"] for r in folds.groupBy("cv_fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 75 and folds.count() == 150
    assert len(learning.cv_evaluate(df, "t", XS, "linear", 4, "matched").collect()) == 4
    assert all(0 <= r["accuracy"] <= 1 for r in learning.cv_evaluate(df, "k", XS, "rf", 3, trees=5, task="classification").collect())
    board = learning.leaderboard(df, "t", XS, ("rf", "linear"), 3, trees=5).collect()
    assert [r["mean_r2"] for r in board] == sorted((r["mean_r2"] for r in board), reverse=True) and not board[0]["tied"] or board[0]["std_r2"] > 0


def test_class_scores(spark):
    m = learning.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string"), "t", "p")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in learning.class_scores(m).collect()}
    assert got == {"a": (1.0, 0.5, pytest.approx(2 / 3)), "b": (pytest.approx(1 / 3), 1.0, 0.5), "c": (0.0, 0.0, 0.0)}


@pytest.mark.parametrize("covariance", learning.COVARIANCES)
def test_mixtures(spark, covariance):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(size=(80, 2)) + 100, rng.normal(size=(80, 2)) * 0.5 + 106])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "fid long, x double, y double")
    rows = learning.gmm(df, ["x", "y"], 2, covariance).orderBy("fid").collect()
    label = [r["cluster_id"] for r in rows]
    assert len(set(label[:80])) == 1 and len(set(label[80:])) == 1 and label[0] != label[80]
    assert all(r["gmm_p0"] + r["gmm_p1"] == pytest.approx(1) for r in rows) and rows[0]["gmm_bic"] > rows[0]["gmm_aic"]


def blobs(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(size=(50, 2)) * 0.3, rng.normal(size=(50, 2)) * 0.3 + 5, [[20.0, -20.0], [-20.0, 20.0]]])
    return spark.createDataFrame([(i * 2, float(a), float(b)) for i, (a, b) in enumerate(pts)], "fid long, x double, y double"), pts


def test_density_clusters(spark):
    df, pts = blobs(spark)
    z = (pts - pts.mean(axis=0)) / pts.std(axis=0)
    d = np.sqrt(((z[:, None] - z) ** 2).sum(axis=2))
    core = (d <= 0.3).sum(axis=1) >= 5
    comp = list(range(len(z)))
    for i in range(len(z)):
        for j in range(len(z)):
            if core[i] and core[j] and d[i, j] <= 0.3 and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    want = [2 * comp[i] if core[i] else 2 * min([comp[j] for j in range(len(z)) if core[j] and d[i, j] <= 0.3], default=-0.5) for i in range(len(z))]
    assert [r["cluster_id"] for r in learning.dbscan(df, 0.3).orderBy("fid").collect()] == want
    rows = regional.hdbscan(df, ["x", "y"]).orderBy("fid").collect()
    label = [r["cluster_id"] for r in rows]
    assert label[-2:] == [-1, -1] and {*label[:50]} - {-1} != {*label[50:100]} - {-1}
    rough = regional.hdbscan(df.filter("abs(x) < 10"), ["x", "y"], exact=10).orderBy("fid").collect()
    assert len(rough) == 100 and len({r["cluster_id"] for r in rough[:50]} - {-1}) == 1
    assert np.mean([x == max(set(label[:50]), key=label[:50].count) for x in label[:50]]) > 0.7 and all(0 <= r["cluster_prob"] <= 1 for r in rows)
    k = [r["cluster_id"] for r in learning.kmeans(df.filter("abs(x) < 10"), ["x", "y"], 2).orderBy("fid").collect()]
    assert len(set(k[:50])) == len(set(k[50:])) == 1 and k[0] != k[50]


def test_spanning_forest_and_components(spark):
    rng = np.random.default_rng(6)
    n, edges = 40, []
    for i in range(n):
        for j in range(i):
            if rng.random() < 0.15:
                edges.append((i, j, float(rng.integers(1, 6))))
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "fid long")
    df = spark.createDataFrame(edges, "a long, b long, cost double")
    got = regional.spanning_forest(nodes, df).collect()
    comp, total, used = list(range(n + 2)), 0.0, 0
    for a, b, c in sorted(edges, key=lambda e: e[2]):
        if comp[a] != comp[b]:
            old, new = comp[a], comp[b]
            comp = [new if x == old else x for x in comp]
            total, used = total + c, used + 1
    assert len(got) == used and sum(r["cost"] for r in got) == total
    stars_ = {r["node"]: r["component"] for r in stars.components(df.selectExpr("a AS u", "b AS v")).collect()}
    groups = {}
    for i, c in enumerate(comp[:n]):
        groups.setdefault(c, []).append(i)
    assert all(stars_.get(i, i) == min(g) for g in groups.values() for i in g)


def test_skater(spark):
    # a 6 by 4 grid whose left, middle and right thirds differ
    rows = [(i, i % 6, i // 6, float(i % 6 // 2) * 5 + (i % 3) * 0.01) for i in range(24)]
    df = spark.createDataFrame(rows, "fid long, col long, row long, v double")
    out = regional.skater(df, neighbours.lattice(df, False), ["v"], 3).orderBy("fid").collect()
    assert len({(r["region_id"], rows[r["fid"]][1] // 2) for r in out}) == 3 and all(r["region_size"] == 8 for r in out)
    assert sum({r["region_id"]: r["region_ssd"] for r in out}.values()) < 0.1
    with pytest.raises(ValueError, match="connected"):
        regional.skater(df, neighbours.lattice(df.filter("col <> 2"), False), ["v"], 2)


def test_ranked(spark):
    df = spark.range(100).selectExpr("(id * 37) % 101 AS k", "id")
    rows = ranked(df, ["k", "id"]).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 101)) and [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_wasserstein():
    assert learning.wasserstein(np.array([0.0, 1.0]), np.array([2.0, 3.0])) == pytest.approx(2.0)


def test_no_weights_no_model():
    with pytest.raises(NotImplementedError):
        learning.tabular_foundation_model()


def test_extra_trees_grow_in_tasks(layer, spark, monkeypatch):
    df = layer[0].select("fid", *XS, F.col("t").alias("label")).dropna()
    y = {r["fid"]: r["label"] for r in df.collect()}

    def error(frame):
        rows = frame.collect()
        assert len(rows) == len(y)
        return np.mean([(r["p"][0] - y[r["fid"]]) ** 2 for r in rows])

    level = error(trees.fitted(df, XS, trees=20, max_depth=6, whole=0))
    monkeypatch.setattr(trees, "grow", None)  # no pass over the data for each level
    tasks = error(trees.fitted(df, XS, trees=20, max_depth=6))
    assert tasks < 1.3 * level
    full = trees.fitted(df.withColumn("label", (F.col("label") > 0).cast("int")), XS, 2, trees=30).collect()
    assert all(sum(r["p"]) == pytest.approx(1) for r in full) and np.mean([(r["p"][1] > 0.5) == (y[r["fid"]] > 0) for r in full]) > 0.95


def test_whole_tree_has_pure_leaves():
    x, y = np.arange(40.0)[:, None], np.arange(40.0) ** 2
    got = trees._tree(x, np.stack([y, y * y], axis=1), np.ones(40), 0, 0, 1, np.random.default_rng(1))
    assert got[:, 0] == pytest.approx(y)
    assert not trees._tree(x, np.stack([y, y * y], axis=1), np.zeros(40), 0, 0, 1, np.random.default_rng(1)).any()
