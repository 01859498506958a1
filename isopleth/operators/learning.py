"""Machine learning over pyspark.ml: fits, explanations, validation by place, clustering.

Tools that elsewhere come from several boosting libraries are one engine here, Spark's trees; outputs name it in the
`engine` column, so nothing passes for a library that isn't there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc
from pyspark.ml import clustering as ml_clustering
from pyspark.ml import regression as mr
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layer import K, pts
from ..plans import neighbours
from ..plans.stars import components
from ..plans.store import stored

SEED = 42


#: Depth of a forest's trees; Spark takes up to 30.
DEPTH = 12


def _ready(df: DataFrame, target: str, xs: list[str], number: bool = True) -> DataFrame:
    """Complete rows with the features as a vector; missing, infinite and unparsable values count alike."""
    from .models import complete

    kept = complete(df, list(dict.fromkeys([target, *xs] if number else xs)))
    return VectorAssembler(inputCols=xs, outputCol="features").transform(kept if number else kept.filter(F.col(target).isNotNull()))


def _regressor(kind: str, trees: int, depth: int, rate: float):
    if kind == "rf":
        return mr.RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=1.0)
    if kind == "gbt":
        return mr.GBTRegressor(labelCol="label", maxIter=trees, maxDepth=min(depth, 5), stepSize=rate, seed=SEED)
    return mr.LinearRegression(labelCol="label")


def _in_order(df: DataFrame) -> DataFrame:
    """The frame, written in the order of its ids: samples are drawn by place, so a fit is the same again."""
    return stored(df.repartitionByRange("fid").sortWithinPartitions("fid"))


def fit_regression(df: DataFrame, target: str, xs: list[str], kind: str = "rf", trees: int = 200, depth: int = DEPTH, rate: float = 0.1):
    """(model, training frame): the frame has label and features."""
    ready = _in_order(_ready(df, target, xs).withColumn("label", F.col(target).cast("double")))
    return _regressor(kind, trees, depth, rate).fit(ready), ready


def regression(df: DataFrame, target: str, xs: list[str], kind: str = "rf", prefix: str = "rf", **more) -> DataFrame:
    """fid, <prefix>_pred, <prefix>_resid, <prefix>_used for every row; NULL where a value is missing."""
    model, ready = fit_regression(df, target, xs, kind, **more)
    got = model.transform(ready).select("fid", F.col("prediction").alias(f"{prefix}_pred"), (F.col("label") - F.col("prediction")).alias(f"{prefix}_resid"), F.lit(1).alias(f"{prefix}_used"), F.lit(f"spark-{kind}").alias("engine"))
    return df.select("fid").join(got, "fid", "left").fillna(0, [f"{prefix}_used"])


def _classifier(kind: str, xs: list[str], classes: int, trees: int, depth: int, steps: int):
    if kind == "mlp":
        return mc.MultilayerPerceptronClassifier(layers=[len(xs), 64, 32, classes], seed=SEED, maxIter=steps)
    if kind == "gbt":
        tool = mc.GBTClassifier(maxIter=trees, maxDepth=min(depth, 5), seed=SEED)
        return tool if classes == 2 else mc.OneVsRest(classifier=tool, parallelism=4)
    if kind == "svc":
        return mc.OneVsRest(classifier=mc.LinearSVC(maxIter=steps), parallelism=4)
    return mc.RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)


def fit_classification(df: DataFrame, target: str, xs: list[str], kind: str = "rf", trees: int = 200, depth: int = DEPTH, steps: int = 1000):
    """(model, training frame, class names in the order of their numbers): the frame has label and features."""
    ready = _ready(df.withColumn("__t", F.col(target).cast("string")), "__t", xs, False)
    if kind == "mlp":  # a network wants values of one scale
        ready = VectorAssembler(inputCols=[f"z_{x}" for x in xs], outputCol="features").transform(_standard(ready.drop("features"), xs))
    index = StringIndexer(inputCol="__t", outputCol="label", stringOrderType="alphabetAsc").fit(ready)
    if len(index.labels) < 2:
        raise ValueError("the target has a single class")
    ready = _in_order(index.transform(ready))
    return _classifier(kind, xs, len(index.labels), trees, depth, steps).fit(ready), ready, list(index.labels)


def classification(df: DataFrame, target: str, xs: list[str], kind: str = "rf", prefix: str = "rf", **more) -> DataFrame:
    """fid, <prefix>_class, <prefix>_conf, <prefix>_used."""
    model, ready, labels = fit_classification(df, target, xs, kind, **more)
    out = model.transform(ready)
    names = F.array(*(F.lit(x) for x in labels))
    if "probability" in out.columns:
        conf = F.array_max(vector_to_array("probability"))
    elif "rawPrediction" in out.columns:
        conf = 1 / (1 + F.exp(-F.array_max(vector_to_array("rawPrediction"))))
    else:
        conf = F.lit(None).cast("double")
    got = out.select("fid", F.element_at(names, F.col("prediction").cast("int") + 1).alias(f"{prefix}_class"), conf.alias(f"{prefix}_conf"), F.lit(1).alias(f"{prefix}_used"), F.lit(f"spark-{kind}").alias("engine"))
    return df.select("fid").join(got, "fid", "left").fillna(0, [f"{prefix}_used"])


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n."""
    return df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """For each class precision, recall, F1 (0 where nothing is divided) and support, from a confusion table."""
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    t = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hit"))
    p = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    both = t.join(p, "class", "full").fillna(0)
    prec, rec = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    return both.select("class", prec.alias("precision"), rec.alias("recall"), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"), F.col("support"))


def spatial_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """df with cv_fold, from k-means on the coordinates."""
    at = VectorAssembler(inputCols=["x", "y"], outputCol="__xy").transform(df)
    return ml_clustering.KMeans(k=folds, featuresCol="__xy", predictionCol="cv_fold", seed=SEED).fit(at).transform(at).drop("__xy")


def _scores(df: DataFrame) -> dict:
    r = df.agg(F.avg((F.col("label") - F.col("prediction")) ** 2).alias("mse"), F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"), F.var_pop("label").alias("v")).first()
    return {"rmse": math.sqrt(r["mse"]), "mae": r["mae"], "r2": 1 - r["mse"] / r["v"] if r["v"] else 0.0}


def wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """Earth mover's distance of two samples, on the quantiles of the larger one."""
    q = (np.arange(max(len(a), len(b))) + 0.5) / max(len(a), len(b))
    return float(np.abs(np.quantile(a, q) - np.quantile(b, q)).mean())


def matched_folds(df: DataFrame, folds: int = 5, tries: int = 200, most_share: float = 0.5, sample: int = 50_000) -> DataFrame:
    """df with cv_fold, so that distances from a fold to the rest are like those from a point to its nearest (Linnenbrink et al. 2024).

    Points are clustered finely; the clusters' centres are grouped into folds in `tries` ways on the driver, and the way
    whose distances have the least earth mover's distance to the nearest-neighbour distances is taken. Distances are
    compared on up to `sample` points, those of the smallest hash of their id.
    """
    pts_ = stored(neighbours.points(df))
    n = pts_.count()
    k = int(min(n, max(folds * 15, 60)))
    at = VectorAssembler(inputCols=["x", "y"], outputCol="__xy").transform(pts_)
    fine = ml_clustering.KMeans(k=k, featuresCol="__xy", predictionCol="micro", seed=SEED).fit(at)
    micro = stored(fine.transform(at).select("fid", "x", "y", "micro"))
    centre = np.array(fine.clusterCenters())
    size = np.zeros(len(centre))
    for r in micro.groupBy("micro").count().collect():  # a row for each fine cluster
        size[r["micro"]] = r["count"]
    target = np.sqrt(neighbours.nearest(micro, 1).join(micro.orderBy(F.xxhash64("fid")).limit(sample).select(F.col("fid").alias("src")), "src").select("d2").toArrow()["d2"].to_numpy())
    some = micro.orderBy(F.xxhash64("fid")).limit(sample).toArrow()  # at most `sample` points
    xy, own = np.column_stack([some["x"].to_numpy(), some["y"].to_numpy()]), some["micro"].to_numpy()
    rng, best = np.random.default_rng(SEED), (math.inf, None)
    # from each fine cluster to each other one, the nearest distance of each of its points
    near = np.full((len(xy), len(centre)), np.inf)
    for c in range(len(centre)):
        other = xy[own == c]
        for a in range(0, len(xy), 2_000):
            if len(other):
                near[a : a + 2_000, c] = np.sqrt(((xy[a : a + 2_000, None] - other) ** 2).sum(axis=2).min(axis=1))
    for _ in range(tries):
        group = _grouped(centre, folds, rng)
        share = np.bincount(group, weights=size, minlength=folds) / n
        if share.min() == 0 or share.max() > most_share:
            continue
        apart = np.where(group[own][:, None] != group[None, :], near, np.inf).min(axis=1)
        if np.isfinite(apart).all():
            best = min(best, (wasserstein(target, apart), group.tolist()), key=lambda v: v[0])
    if best[1] is None:
        raise ValueError("no balanced folds; take fewer")
    fold = F.element_at(F.array(*map(F.lit, best[1])), F.col("micro") + 1)
    return df.join(micro.select("fid", fold.alias("cv_fold")), "fid", "left")


def _grouped(centre: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of a few hundred centres from random ones."""
    own = centre[rng.choice(len(centre), k, replace=False)]
    for _ in range(50):
        label = ((centre[:, None] - own) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([centre[label == j].mean(axis=0) if (label == j).any() else own[j] for j in range(k)])
        if np.allclose(new, own):
            break
        own = new
    return label


def cv_evaluate(df: DataFrame, target: str, xs: list[str], kind: str = "rf", folds: int = 5, method: str = "kmeans", trees: int = 200, task: str = "regression") -> DataFrame:
    """A row for each fold of the model fitted without it: r2, rmse and mae, or accuracy and macro F1. Folds are k-means blocks, or distance-matched."""
    data = stored((spatial_folds if method == "kmeans" else matched_folds)(df, folds))
    rows = []
    for k in range(folds):
        train, test = data.filter(F.col("cv_fold") != k), data.filter(F.col("cv_fold") == k)
        if task == "regression":
            model, _ = fit_regression(train, target, xs, kind, trees=trees)
            s = _scores(model.transform(_ready(test, target, xs).withColumn("label", F.col(target).cast("double"))))
            rows.append((k, s["r2"], s["rmse"], s["mae"]))
        else:
            model, _, labels = fit_classification(train, target, xs, kind, trees=trees)
            got = model.transform(_ready(test.withColumn("__t", F.col(target).cast("string")), "__t", xs, False))
            said = F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1)
            m = stored(confusion(got.withColumn("__p", said), "__t", "__p"))
            acc = m.agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
            rows.append((k, acc, class_scores(m).agg(F.avg("f1")).first()[0], None))
    names = "r2 double, rmse double, mae double" if task == "regression" else "accuracy double, macro_f1 double, none double"
    out = df.sparkSession.createDataFrame(rows, "fold int, " + names)
    return out if task == "regression" else out.drop("none")


def leaderboard(df: DataFrame, target: str, xs: list[str], kinds: tuple[str, ...] = ("rf", "gbt", "linear"), folds: int = 5, trees: int = 200) -> DataFrame:
    """Mean and spread of each model's fold scores, the best first; `tied`: closer to the best than its spread."""
    out = None
    for kind in kinds:
        row = cv_evaluate(df, target, xs, kind, folds, trees=trees).agg(F.lit(kind).alias("model"), F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"), F.avg("rmse").alias("mean_rmse"))
        out = row if out is None else out.unionByName(row)
    out = stored(out)
    best = out.orderBy(F.desc("mean_r2")).first()
    return out.withColumn("tied", F.lit(best["mean_r2"]) - F.col("mean_r2") < F.lit(best["std_r2"])).orderBy(F.desc("mean_r2"))


def permutation_importance(df: DataFrame, target: str, xs: list[str], repeats: int = 10, trees: int = 200) -> DataFrame:
    """Loss of R2 when one column is dealt anew, by joining places in id order with places in a hashed order; one pass scores all repeats of a field."""
    from ..plans.ranks import ranked

    model, ready = fit_regression(df, target, xs, "rf", trees=trees)
    base = _scores(model.transform(ready))["r2"]
    own = stored(ranked(ready.select("fid", "label", *xs), ["fid"]))
    rows = []
    for x in xs:
        mixed = None
        for r in range(repeats):
            deal = F.md5(F.concat(F.lit(f"{SEED}:{r}:"), F.col("fid").cast("string")))
            other = ranked(own.select("fid", F.col(x).alias("v"), deal.alias("deal")), ["deal", "fid"]).select("place", "v")
            part = own.join(other, "place").withColumn(x, F.col("v")).withColumn("r", F.lit(r))
            mixed = part if mixed is None else mixed.unionByName(part)
        got = model.transform(VectorAssembler(inputCols=xs, outputCol="features").transform(mixed))
        err = got.groupBy("r").agg(F.avg((F.col("label") - F.col("prediction")) ** 2).alias("mse"), F.var_pop("label").alias("v")).collect()
        drops = [base - (1 - e["mse"] / e["v"]) for e in err]
        rows.append((x, float(np.mean(drops)), float(np.std(drops))))
    return df.sparkSession.createDataFrame(rows, "field string, importance double, std double").orderBy(F.desc("importance"))


def partial_dependence(df: DataFrame, target: str, xs: list[str], field: str, points: int = 20, trees: int = 200) -> DataFrame:
    """Mean prediction with the field set to each of a grid of values between its 5th and 95th percentiles."""
    model, ready = fit_regression(df, target, xs, "rf", trees=trees)
    low, high = ready.agg(F.percentile(field, F.array(F.lit(0.05), F.lit(0.95)))).first()[0]
    step = (high - low) / max(1, points - 1)
    grid = F.explode(F.array(*(F.lit(low + step * i) for i in range(points))))
    wide = ready.drop("features").withColumn("grid", grid).withColumn(field, F.col("grid"))
    return model.transform(VectorAssembler(inputCols=xs, outputCol="features").transform(wide)).groupBy("grid").agg(F.avg("prediction").alias("mean_prediction")).orderBy("grid")


def uncertainty(df: DataFrame, target: str, xs: list[str], trees: int = 200) -> DataFrame:
    """Mean, spread, 10th and 90th percentile of the trees' own predictions."""
    model, ready = fit_regression(df, target, xs, "rf", trees=trees)
    from .explain import parsed

    sent = df.sparkSession.sparkContext.broadcast(parsed(model))

    def run(batches):
        for b in batches:
            g, x = sent.value, b[xs].to_numpy(dtype=float)
            p = np.stack([np.array(g.value[t])[g.nodes(t, x), 0] for t in range(len(g.feature))]) if len(b) else np.zeros((1, 0))
            low, high = np.quantile(p, [0.1, 0.9], axis=0)
            yield pd.DataFrame({"fid": b["fid"], "unc_pred": p.mean(axis=0), "unc_std": p.std(axis=0), "unc_low": low, "unc_high": high})

    got = ready.select("fid", *xs).mapInPandas(run, "fid long, unc_pred double, unc_std double, unc_low double, unc_high double")
    return df.select("fid").join(got, "fid", "left")


def conformal(df: DataFrame, target: str, xs: list[str], alpha: float = 0.1, folds: int = 5, trees: int = 200) -> DataFrame:
    """CV+ intervals: each row's predictions by all fold models, widened by the out-of-fold residual quantile."""
    data = _ready(df, target, xs).withColumn("label", F.col(target).cast("double")).withColumn("f", F.pmod(F.xxhash64("fid"), F.lit(folds)))
    data = stored(data)
    models = [_regressor("rf", trees, DEPTH, 0.1).fit(data.filter(F.col("f") != k)) for k in range(folds)]
    out = data
    for k, m in enumerate(models):
        out = m.setPredictionCol(f"p{k}").transform(out)
    preds = F.array(*(F.col(f"p{k}") for k in range(folds)))
    out = stored(out.withColumn("own", F.element_at(preds, (F.col("f") + 1).cast("int"))).drop("features"))
    n = out.count()
    level = min(1.0, math.ceil((1 - alpha) * (n + 1)) / n)
    q = out.agg(F.percentile(F.abs(F.col("label") - F.col("own")), F.lit(level))).first()[0]
    mean = F.aggregate(preds, F.lit(0.0), lambda a, x: a + x) / folds
    return out.select("fid", mean.alias("conf_pred"), (F.array_min(preds) - q).alias("conf_low"), (F.array_max(preds) + q).alias("conf_high")).withColumn("conf_width", F.col("conf_high") - F.col("conf_low"))


def _standard(df: DataFrame, xs: list[str]) -> DataFrame:
    s = df.agg(*(F.avg(x).alias(f"a_{x}") for x in xs), *(F.stddev_pop(x).alias(f"d_{x}") for x in xs)).first()
    return df.withColumns({f"z_{x}": (F.col(x) - s[f"a_{x}"]) / (s[f"d_{x}"] or 1.0) for x in xs})


def kmeans(df: DataFrame, xs: list[str], k: int = 3) -> DataFrame:
    z = VectorAssembler(inputCols=[f"z_{x}" for x in xs], outputCol="features").transform(_standard(df.dropna(subset=xs), xs))
    model = ml_clustering.KMeans(k=k, seed=SEED, maxIter=100, predictionCol="cluster_id").fit(z)
    out = model.transform(z)
    centre = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in model.clusterCenters())), F.col("cluster_id") + 1)
    dist = F.sqrt(sum(((F.col(f"z_{x}") - F.element_at(centre, i + 1)) ** 2 for i, x in enumerate(xs)), F.lit(0.0)))
    size = out.groupBy("cluster_id").agg(F.count("*").alias("clust_size"))
    return out.select("fid", "cluster_id", dist.alias("clust_dist")).join(F.broadcast(size), "cluster_id")


COVARIANCES = ("full", "tied", "diag", "spherical")


def gmm(df: DataFrame, xs: list[str], k: int = 3, covariance: str = "full", steps: int = 100, tolerance: float = 1e-3) -> DataFrame:
    """fid, cluster_id, gmm_p<i>, gmm_entropy, gmm_bic, gmm_aic: a mixture of normal distributions by expectation and maximisation.

    Each step is one pass that sums responsibilities, values and products; the covariance's form is imposed on the sums.
    """
    from .kernels import summed
    from .models import complete

    if covariance not in COVARIANCES:
        raise ValueError(f"no covariance {covariance!r}")
    d = stored(complete(df, xs).select("fid", *xs))
    p, n = len(xs), d.count()
    z = VectorAssembler(inputCols=xs, outputCol="features").transform(d)
    mean = np.array(ml_clustering.KMeans(k=k, seed=SEED).fit(z).clusterCenters())
    spread = d.agg(*(F.var_pop(x) for x in xs)).first()
    cov, weight, before = np.stack([np.diag([v or 1.0 for v in spread])] * k), np.full(k, 1 / k), -math.inf

    def log_parts(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), k))
        for j in range(k):
            low = np.linalg.cholesky(cov[j])
            u = np.linalg.solve(low, (x - mean[j]).T)
            out[:, j] = math.log(max(weight[j], 1e-300)) - 0.5 * (p * math.log(2 * math.pi) + (u * u).sum(axis=0)) - np.log(np.diag(low)).sum()
        return out

    def part(b: pd.DataFrame) -> np.ndarray:
        x = b[xs].to_numpy(dtype=float)
        l = log_parts(x)
        top = l.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(l - top).sum(axis=1, keepdims=True))
        r = np.exp(l - total)
        dx = x[:, None, :] - mean[None]  # about the last means, so that nothing cancels
        return np.concatenate([r.sum(axis=0), (r[:, :, None] * dx).sum(axis=0).reshape(-1), np.einsum("nk,nki,nkj->kij", r, dx, dx).reshape(-1), [total.sum()]])

    for _ in range(steps):
        got = summed(d, part, k + k * p + k * p * p + 1)
        r, first, second, ll = got[:k], got[k : k + k * p].reshape(k, p), got[k + k * p : -1].reshape(k, p, p), got[-1] / n
        r = np.maximum(r, 1e-10)
        shift = first / r[:, None]
        own = second / r[:, None, None] - shift[:, :, None] * shift[:, None, :]
        mean, weight = mean + shift, r / n
        if covariance == "tied":
            own = np.stack([(own * weight[:, None, None]).sum(axis=0)] * k)
        elif covariance == "diag":
            own = own * np.eye(p)
        elif covariance == "spherical":
            own = np.stack([np.eye(p) * np.trace(c) / p for c in own])
        cov = own + 1e-6 * np.eye(p)
        if abs(ll - before) < tolerance:
            break
        before = ll
    free = k * p + k - 1 + {"full": k * p * (p + 1) // 2, "tied": p * (p + 1) // 2, "diag": k * p, "spherical": k}[covariance]
    ll = float(summed(d, part, k + k * p + k * p * p + 1)[-1])
    bic, aic = -2 * ll + free * math.log(n), -2 * ll + 2 * free

    def run(batches):
        for b in batches:
            l = log_parts(b[xs].to_numpy(dtype=float))
            r = np.exp(l - l.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            yield pd.DataFrame({"fid": b["fid"], "cluster_id": r.argmax(axis=1)} | {f"gmm_p{j}": r[:, j] for j in range(k)} | {"gmm_entropy": -(r * np.log(np.maximum(r, 1e-300))).sum(axis=1), "gmm_bic": bic, "gmm_aic": aic})

    got = d.mapInPandas(run, "fid long, cluster_id int, " + ", ".join(f"gmm_p{j} double" for j in range(k)) + ", gmm_entropy double, gmm_bic double, gmm_aic double")
    return df.select("fid").join(got, "fid", "left")


def dbscan(df: DataFrame, eps: float = 0.75, least: int = 5, fields: tuple[str, str] = ("x", "y")) -> DataFrame:
    """fid, cluster_id (-1: noise): density clusters of two standardised fields. An eps join on grid cells, core points, then components of core links by stars."""
    from .models import complete

    a, b = fields
    z = _standard(complete(df, [a, b]), [a, b]).select("fid", F.col(f"z_{a}").alias("x"), F.col(f"z_{b}").alias("y"))
    near = stored(neighbours.within(z, eps).select("src", "dst"))
    core = stored(near.groupBy("src").agg(F.count("*").alias("m")).filter(F.col("m") + 1 >= least).select("src"))
    links = near.filter("src < dst").join(core, "src", "left_semi").join(core.select(F.col("src").alias("dst")), "dst", "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    labels = core.join(components(links).withColumnRenamed("node", "src"), "src", "left").select("src", F.coalesce("component", "src").alias("label"))
    border = near.join(labels.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(F.min("label").alias("b"))
    return df.select("fid").join(labels.withColumnRenamed("src", "fid"), "fid", "left").join(border.withColumnRenamed("src", "fid"), "fid", "left").select("fid", F.coalesce("label", "b", F.lit(-1)).cast("long").alias("cluster_id"))


def residual_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pattern import moran

    df = pts(spark, sf_dir)
    res = stored(regression(df, "v1", ["v2", "v3"]).filter("rf_used = 1").select("fid", F.col("rf_resid").alias("v1")))
    edges = stored(neighbours.restricted(neighbours.nearest(df, K).select("src", "dst"), res))
    return moran("pts", "v1", "knn").run(spark, {"pts": res, "knn": edges})


def tabular_foundation_model(*_, **__):
    """Needs pretrained weights that aren't here; nothing stands in for them."""
    raise NotImplementedError("this model needs pretrained weights, which are not available")


def _gbm(task: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pts(spark, sf_dir)
        return regression(df, "v1", _X, "gbt", "gbm", trees=ROUNDS, depth=3) if task == "regression" else classification(df, "cat", ["v1", *_X], "gbt", "gbm", trees=ROUNDS_OF_A_CLASS, depth=3)

    return run


def _extra(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import kernels, trees

        df, more = pts(spark, sf_dir), ["v1", *_X]
        return {
            "extra_trees_regression": lambda: trees.extra_trees_regression(df, "v1", _X),
            "extra_trees_classification": lambda: trees.extra_trees_classification(df, "cat", more),
            "support_vector_regression": lambda: kernels.support_vector_regression(df, "v1", _X),
            "support_vector_classification": lambda: kernels.support_vector_classification(df, "cat", more),
            "mlp_regression": lambda: kernels.mlp_regression(df, "v1", _X),
        }[name]()

    return run


def _region(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import regional

        df = pts(spark, sf_dir)
        if name == "hdbscan_clustering":
            return regional.hdbscan(df, ["x", "y"])
        return regional.skater(df, stored(neighbours.nearest(df, K).select("src", "dst")), ["v1", "v2"], 4)

    return run


_X = ["v2", "v3", "v4"]
#: Rounds of boosting in the registered queries (the operators' default is 200): Spark fits round by round, a few jobs each.
ROUNDS, ROUNDS_OF_A_CLASS = 40, 8
STATEMENTS: dict = {}
QUERIES = {
    "random_forest_regression": lambda s, d: regression(pts(s, d), "v1", _X),
    "random_forest_classification": lambda s, d: classification(pts(s, d), "cat", ["v1", *_X]),
    **{f"gbm_{t}_{e}": _gbm(t) for t in ("regression", "classification") for e in ("sklearn", "xgboost", "lightgbm", "catboost")},
    **{n: _extra(n) for n in ("extra_trees_regression", "extra_trees_classification", "support_vector_regression", "support_vector_classification", "mlp_regression")},
    "mlp_classification": lambda s, d: classification(pts(s, d), "cat", ["v1", *_X], "mlp", "mlp", steps=200),
    "spatial_kfold_cv_evaluator": lambda s, d: cv_evaluate(pts(s, d), "v1", _X),
    "spatial_kfold_cv_matched": lambda s, d: cv_evaluate(pts(s, d), "v1", _X, "linear", method="matched"),
    "ml_model_comparison": lambda s, d: leaderboard(pts(s, d), "v1", _X, trees=20),
    "permutation_feature_importance": lambda s, d: permutation_importance(pts(s, d), "v1", _X),
    "partial_dependence_report": lambda s, d: partial_dependence(pts(s, d), "v1", _X, "v2"),
    "prediction_uncertainty_map": lambda s, d: uncertainty(pts(s, d), "v1", _X),
    "conformal_prediction_interval": lambda s, d: conformal(pts(s, d), "v1", _X),
    "multivariate_clustering": lambda s, d: kmeans(pts(s, d), ["v1", "v2"]),
    "gmm_clustering": lambda s, d: gmm(pts(s, d), ["v1", "v2"]),
    "gmm_clustering_tied": lambda s, d: gmm(pts(s, d), ["v1", "v2"], covariance="tied"),
    "dbscan_clustering": lambda s, d: dbscan(pts(s, d), 0.3),
    "hdbscan_clustering": _region("hdbscan_clustering"),
    "skater_regionalization": _region("skater_regionalization"),
    "model_residual_autocorrelation": residual_autocorrelation,
}

ORACLES = {
    "dbscan_clustering": """WITH RECURSIVE p AS (SELECT vec_id AS fid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS dx, avg(y) AS my, stddev_pop(y) AS dy FROM p), z AS (SELECT fid, (x - mx) / dx AS x, (y - my) / dy AS y FROM p, s),
near AS (SELECT a.fid AS src, b.fid AS dst FROM z a JOIN z b ON a.fid <> b.fid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CAST(0.3 AS DOUBLE) * CAST(0.3 AS DOUBLE)),
core AS (SELECT src AS c FROM near GROUP BY src HAVING count(*) + 1 >= 5), link AS (SELECT src, dst FROM near WHERE src IN (SELECT c FROM core) AND dst IN (SELECT c FROM core)),
reach(a, b) AS (SELECT c, c FROM core UNION SELECT reach.a, link.dst FROM reach JOIN link ON link.src = reach.b),
own AS (SELECT a AS fid, min(b) AS l FROM reach GROUP BY a), edge AS (SELECT src AS fid, min(l) AS l FROM near JOIN own ON own.fid = near.dst GROUP BY src)
SELECT z.fid, CAST(coalesce(own.l, edge.l, -1) AS BIGINT) AS cluster_id FROM z LEFT JOIN own ON own.fid = z.fid LEFT JOIN edge ON edge.fid = z.fid""",
}
