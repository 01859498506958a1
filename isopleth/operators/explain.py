"""Explanations: Shapley values of tree ensembles, counterfactuals, and additive models whose terms explain themselves."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layer import pts
from ..plans.store import stored
from .trees import Grown

#: Fields of an exact Shapley value, whose cost doubles with each.
FIELDS = 12


def parsed(model) -> Grown:
    """The trees of a fitted Spark forest or boosted model as arrays; boosted trees' values carry their weights times their number."""
    g, weights = Grown(), []
    for line in model.toDebugString.splitlines():
        text = line.strip()
        if m := re.match(r"Tree \d+ \(weight ([-\d.Ee+]+)\)", text):
            weights.append(float(m[1]))
            for v in (g.feature, g.cut, g.child, g.value):
                v.append([])
            stack: list[int] = []
        elif m := re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee+]+)\)", text):
            if m[1] == "Else":
                continue
            n = _new(g)
            _attach(g, stack, n)
            g.feature[-1][n], g.cut[-1][n] = int(m[2]), float(m[4])
            stack.append(n)
        elif m := re.match(r"Predict: ([-\d.Ee+]+)", text):
            n = _new(g)
            g.value[-1][n] = [float(m[1])]
            _attach(g, stack, n)
    boosted = any(w != 1.0 for w in weights) or "GBT" in model.toDebugString.split("\n")[0]
    for t, w in enumerate(weights):
        if boosted:
            g.value[t] = [[v * w * len(weights) for v in x] for x in g.value[t]]
        _in_pairs(g, t)
    return g


def _new(g: Grown) -> int:
    for v, x in ((g.feature, -1), (g.cut, 0.0), (g.child, []), (g.value, [0.0])):
        v[-1].append(list(x) if isinstance(x, list) else x)
    return len(g.feature[-1]) - 1


def _attach(g: Grown, stack: list[int], n: int) -> None:
    while stack and len(g.child[-1][stack[-1]]) == 2:
        stack.pop()
    if stack:
        g.child[-1][stack[-1]].append(n)


def _in_pairs(g: Grown, t: int) -> None:
    """Numbers the nodes anew, so that a right child follows its left one."""
    order, at = [0], 0
    while at < len(order):
        order += g.child[t][order[at]]
        at += 1
    place = {n: i for i, n in enumerate(order)}
    g.child[t] = [place[g.child[t][n][0]] if g.child[t][n] else -1 for n in order]
    g.feature[t], g.cut[t], g.value[t] = ([v[t][n] for n in order] for v in (g.feature, g.cut, g.value))


def covers(df: DataFrame, g: Grown, xs: list[str], label: str | None = None, classes: int = 0) -> list[np.ndarray]:
    """How many rows of df reach each node of each tree, in one pass; with classes, a count for each class."""
    sent, k = df.sparkSession.sparkContext.broadcast(g), classes or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        sums = [np.zeros((len(f), k)) for f in g.feature]
        for b in batches:
            x = b[xs].to_numpy(dtype=float)
            c = b[label].to_numpy(dtype=int) if classes else np.zeros(len(b), dtype=int)
            for t in range(len(sums)):
                np.add.at(sums[t], (g.nodes(t, x), c), 1.0)
        rows = [(t, n, j, v) for t, s in enumerate(sums) for n, r in enumerate(s) for j, v in enumerate(r) if v]
        yield pd.DataFrame(rows, columns=["t", "n", "j", "v"])

    got = df.select(*xs, *([label] if classes else [])).mapInPandas(run, "t int, n int, j int, v double").groupBy("t", "n", "j").agg(F.sum("v").alias("v"))
    out = [np.zeros((len(f), k)) for f in g.feature]
    for r in got.collect():  # the leaves of the model
        out[r["t"]][r["n"], r["j"]] = r["v"]
    for t, child in enumerate(g.child):
        for n in range(len(child) - 1, -1, -1):
            if child[n] >= 0:
                out[t][n] = out[t][child[n]] + out[t][child[n] + 1]
    return out


def expectations(g: Grown, cover: list[np.ndarray], value: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """For each row and each set of known fields (a bit each) the mean value when the other fields follow the training rows down each tree."""
    p = x.shape[1]
    known = (np.arange(1 << p)[:, None] >> np.arange(p)) & 1 == 1
    out = np.zeros((len(x), 1 << p))
    for t in range(len(g.feature)):
        todo = [(0, np.ones((len(x), 1 << p)))]
        while todo:
            n, w = todo.pop()
            j = g.feature[t][n]
            if j < 0:
                out += w * value[t][n]
                continue
            left, total = g.child[t][n], max(cover[t][n], 1e-300)
            goes = (x[:, j] <= g.cut[t][n])[:, None]
            share = cover[t][left] / total
            todo.append((left, w * np.where(known[:, j][None, :], goes, share)))
            todo.append((left + 1, w * np.where(known[:, j][None, :], ~goes, 1 - share)))
    return out / len(g.feature)


def shapley(e: np.ndarray, p: int) -> np.ndarray:
    """Shapley values from expectations over all sets of fields."""
    masks = np.arange(1 << p)
    size = np.array([int(m).bit_count() for m in masks])
    out = np.zeros((len(e), p))
    for j in range(p):
        without = masks[masks >> j & 1 == 0]
        weight = np.array([math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p) for s in size[without]])
        out[:, j] = (e[:, without | 1 << j] - e[:, without]) @ weight
    return out


def shap_values(df: DataFrame, target: str, xs: list[str], kind: str = "rf", task: str = "regression", class_label: str | None = None, rows: int | None = None, fitted: tuple | None = None, **more) -> DataFrame:
    """fid, shap_<field>, shap_base, shap_pred, shap_used for every row: exact path-dependent Shapley values of a fitted ensemble.

    For classes, of the share of class_label among the training rows of each leaf (by default the last class). `rows` explains that many rows only, those of the smallest hash of their id. `fitted` is what fit_regression or fit_classification gave.
    """
    from .learning import fit_classification, fit_regression

    if len(xs) > FIELDS:
        raise ValueError(f"up to {FIELDS} fields")
    if task == "regression":
        model, ready = fitted or fit_regression(df, target, xs, kind, **more)
        g = parsed(model)
        cover = [c[:, 0] for c in covers(ready, g, xs)]
        value = [np.array([v[0] for v in t]) for t in g.value]
        shift = 0.0
    else:
        model, ready, labels = fitted or fit_classification(df, target, xs, kind, **more)
        g, at = parsed(model), labels.index(class_label) if class_label is not None else len(labels) - 1
        by_class = covers(ready, g, xs, "label", len(labels))
        cover = [c.sum(axis=1) for c in by_class]
        value, shift = [c[:, at] / np.maximum(c.sum(axis=1), 1e-300) for c in by_class], 0.0
    sent = df.sparkSession.sparkContext.broadcast((g, cover, value))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 512):
                part = b.iloc[a : a + 512]
                e = expectations(*sent.value, part[xs].to_numpy(dtype=float))
                v = shapley(e, len(xs))
                yield pd.DataFrame({"fid": part["fid"]} | {f"shap_{c}": v[:, j] for j, c in enumerate(xs)} | {"shap_base": e[:, 0] + shift, "shap_pred": e[:, -1] + shift, "shap_used": 1})

    some = ready.select("fid", *xs)
    if rows is not None:
        some = some.orderBy(F.xxhash64("fid"), "fid").limit(rows)
    got = some.mapInPandas(run, "fid long, " + ", ".join(f"shap_{c} double" for c in xs) + ", shap_base double, shap_pred double, shap_used int")
    return df.select("fid").join(got, "fid", "left").fillna(0, ["shap_used"])


def shap_importance(values: DataFrame, xs: list[str]) -> DataFrame:
    """field, importance: the mean size of its Shapley values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.abs(F.col(f"shap_{c}")).alias("v")) for c in xs))).alias("e")
    return values.filter("shap_used = 1").select(pairs).groupBy("e.field").agg(F.avg("e.v").alias("importance")).orderBy(F.desc("importance"))


def shap_local(values: DataFrame, xs: list[str], fid: int) -> DataFrame:
    """field, contribution of one row, the largest first, with base and prediction."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"shap_{c}").alias("v")) for c in xs))).alias("e")
    return values.filter(F.col("fid") == fid).select(pairs, "shap_base", "shap_pred").select("e.field", F.col("e.v").alias("contribution"), F.col("shap_base").alias("base"), F.col("shap_pred").alias("prediction")).orderBy(F.desc(F.abs("contribution")))


def counterfactuals(df: DataFrame, target: str, xs: list[str], fid: int, desired: str | None = None, n: int = 4, immutable: tuple[str, ...] = (), tries: int = 20_000, seed: int = 42, **more) -> DataFrame:
    """Up to n edits of one row that the classifier puts into the desired class: the fewest fields changed first, then the nearest.

    A candidate changes a random set of the mutable fields to values drawn between their observed extremes.
    """
    from pyspark.ml.feature import VectorAssembler

    from .learning import fit_classification

    spark = df.sparkSession
    model, ready, labels = fit_classification(df, target, xs, "rf", **more)
    row = ready.filter(F.col("fid") == fid).first()
    if row is None:
        raise ValueError(f"no complete row {fid}")
    own = labels[int(model.predict(row["features"]))]
    if desired is None:
        if len(labels) != 2:
            raise ValueError("name the desired class, as there are more than two")
        desired = next(x for x in labels if x != own)
    if desired not in labels:
        raise ValueError(f"no class {desired!r}")
    free = [x for x in xs if x not in immutable]
    if not free:
        raise ValueError("every field is immutable")
    s = ready.agg(*(f(x).alias(f"{k}_{x}") for x in free for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop)))).first()

    def drawn(i: int, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)

    cand = spark.range(tries)
    changed = {x: drawn(i, 0) < 0.5 for i, x in enumerate(free)}
    cols = {x: F.when(changed[x], F.lit(s[f"lo_{x}"]) + drawn(i, 1) * float(s[f"hi_{x}"] - s[f"lo_{x}"])).otherwise(F.lit(float(row[x]))) for i, x in enumerate(free)}
    cand = cand.select("id", *((cols[x] if x in cols else F.lit(float(row[x]))).alias(x) for x in xs))
    got = model.transform(VectorAssembler(inputCols=xs, outputCol="features").transform(cand)).filter(F.col("prediction") == labels.index(desired))
    count = sum(((F.col(x) != float(row[x])).cast("int") for x in free), F.lit(0))
    far = sum((F.abs(F.col(x) - float(row[x])) / (s[f"sd_{x}"] or 1.0) for x in free), F.lit(0.0))
    return got.select(F.lit(fid).cast("long").alias("fid"), *xs, F.lit(desired).alias("class"), count.alias("changes"), far.alias("distance")).filter("changes > 0").orderBy("changes", "distance").limit(n)


def _bins(df: DataFrame, xs: list[str], bins: int) -> dict[str, list[float]]:
    """Inner edges of each field: distinct quantiles."""
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    row = df.agg(*(F.percentile(x, at).alias(f"q{i}") for i, x in enumerate(xs))).first()
    return {x: sorted(set(row[f"q{i}"])) for i, x in enumerate(xs)}


def _tables(df: DataFrame, xs: list[str], sizes: list[int], w, t) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """Weights of each pair of fields' bins, and weighted targets of each field's bins, in one pass."""
    p = len(xs)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b_{xs[i]}").alias("a"), F.col(f"b_{xs[j]}").alias("b"), w.alias("w"), (w * t).alias("t")) for i in range(p) for j in range(i, p)]
    got = df.select(F.explode(F.array(*pairs)).alias("e")).groupBy("e.i", "e.j", "e.a", "e.b").agg(F.sum("e.w").alias("w"), F.sum("e.t").alias("t")).collect()  # bins squared for each pair of fields
    n = [[np.zeros((sizes[i], sizes[j])) for j in range(p)] for i in range(p)]
    s = [np.zeros(sizes[i]) for i in range(p)]
    for r in got:
        n[r["i"]][r["j"]][r["a"], r["b"]] = r["w"]
        n[r["j"]][r["i"]][r["b"], r["a"]] = r["w"]
        if r["i"] == r["j"]:
            s[r["i"]][r["a"]] = r["t"]
    return n, s


def _boost(n: list[list[np.ndarray]], s: list[np.ndarray], f: list[np.ndarray], rounds: int, rate: float, ridge: float) -> tuple[float, list[np.ndarray]]:
    """Cyclic boosting of one step a field and round, from the tables alone: the residual mean of a bin follows from the weights that it shares with other fields' bins."""
    own = [np.diag(n[i][i]) for i in range(len(s))]
    total = own[0].sum()
    base = (s[0].sum() - sum(own[j] @ f[j] for j in range(len(f)))) / total
    for _ in range(rounds):
        for i in range(len(s)):
            res = s[i] - base * own[i] - sum(n[i][j] @ f[j] for j in range(len(f)))
            f[i] = f[i] + rate * res / (own[i] + ridge)
        base = (s[0].sum() - sum(own[j] @ f[j] for j in range(len(f)))) / total
    for i in range(len(f)):
        shift = own[i] @ f[i] / total
        f[i], base = f[i] - shift, base + shift
    return base, f


def ebm(df: DataFrame, target: str, xs: list[str], task: str = "regression", bins: int = 64, rounds: int = 400, rate: float = 0.1, ridge: float = 1.0, steps: int = 8) -> DataFrame:
    """Additive boosted model: fid, ebm_pred, ebm_resid (or ebm_class, ebm_conf), ebm_intercept, ebm_used and ebm_<field>, each field's exact contribution.

    Fields are cut at quantiles; boosting goes round the fields, on tables of bins that one pass over the data sums up. For
    two classes those tables are of Newton weights, and a pass is made for each of up to `steps` of them.
    """
    from .models import complete

    d = complete(df, xs if task != "regression" else [target, *xs])
    labels: list[str] = []
    if task == "regression":
        d = d.withColumn("label", F.col(target))
    else:
        d = d.filter(F.col(target).isNotNull())
        labels = [r[0] for r in d.select(F.col(target).cast("string").alias("t")).distinct().orderBy("t").limit(3).collect()]
        if len(labels) != 2:
            raise ValueError("the target must have two classes")
        d = d.withColumn("label", (F.col(target).cast("string") == labels[1]).cast("double"))
    edges = _bins(d, xs, bins)
    sizes = [len(edges[x]) + 1 for x in xs]

    def bin_of(x: str):
        inner = F.array(*map(F.lit, edges[x])) if edges[x] else F.expr("array()").cast("array<double>")
        return F.size(F.filter(inner, lambda v: v < F.col(x)))

    cut = {f"b_{x}": bin_of(x) for x in xs}
    d = stored(d.withColumns(cut).select("fid", "label", *cut))
    f = [np.zeros(k) for k in sizes]

    def score(base: float):
        return sum((F.element_at(F.array(*(F.lit(float(v)) for v in f[i])), F.col(f"b_{x}") + 1) for i, x in enumerate(xs)), F.lit(float(base)))

    if task == "regression":
        base, f = _boost(*_tables(d, xs, sizes, F.lit(1.0), F.col("label")), f, rounds, rate, ridge)
    else:
        share = d.agg(F.avg("label")).first()[0]
        base = math.log(share / (1 - share))
        for _ in range(steps):
            z = score(base)
            mu = 1 / (1 + F.exp(-z))
            w = F.greatest(mu * (1 - mu), F.lit(1e-6))
            old = [v.copy() for v in f]
            step = stored(d.select(*cut, w.alias("w"), (z + (F.col("label") - mu) / w).alias("t")))
            base, f = _boost(*_tables(step, xs, sizes, F.col("w"), F.col("t")), f, rounds, rate, ridge)
            if max(float(np.abs(a - b).max()) for a, b in zip(f, old, strict=True)) < 1e-4:
                break
    d = stored(d.withColumn("z", score(base)))
    z = F.col("z")
    parts = [F.element_at(F.array(*(F.lit(float(v)) for v in f[i])), F.col(f"b_{x}") + 1).alias(f"ebm_{x}") for i, x in enumerate(xs)]
    p = 1 / (1 + F.exp(-z))
    made = [z.alias("ebm_pred"), (F.col("label") - z).alias("ebm_resid")] if task == "regression" else [F.when(p >= 0.5, labels[1]).otherwise(labels[0]).alias("ebm_class"), F.greatest(p, 1 - p).alias("ebm_conf")]
    got = d.select("fid", *made, F.lit(float(base)).alias("ebm_intercept"), F.lit(1).alias("ebm_used"), *parts)
    return df.select("fid").join(got, "fid", "left").fillna(0, ["ebm_used"])


_X = ["v2", "v3", "v4"]
STATEMENTS: dict = {}
QUERIES = {
    "shap_global_importance": lambda s, d: shap_importance(shap_values(pts(s, d), "v1", _X), _X),
    "shap_spatial_map": lambda s, d: shap_values(pts(s, d), "v1", _X),
    "shap_local_explanation": lambda s, d: shap_local(shap_values(pts(s, d), "v1", _X), _X, 7),
    "dice_counterfactual_explanation": lambda s, d: counterfactuals(pts(s, d), "cat", ["v1", *_X], 7, "3"),
    "ebm_regression": lambda s, d: ebm(pts(s, d), "v1", _X),
    "ebm_classification": lambda s, d: ebm(pts(s, d).withColumn("low", (F.col("cat") < 5).cast("string")), "low", ["v1", *_X], "classification"),
}
