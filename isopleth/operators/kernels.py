"""Support vectors and networks: kernels as explicit features, fitted from sums or by averaged local steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import stored
from .learning import SEED, _standard


class Features:
    """The features of a kernel over standardised fields: the fields, random cosines (Rahimi and Recht 2007), or all products up to degree 3."""

    def __init__(self, kernel: str, p: int, size: int = 200, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.kernel = kernel
        if kernel == "rbf":  # of width 1 / p, as the fields have unit variance
            self.w, self.b = rng.normal(0, math.sqrt(2 / p), (p, size)), rng.uniform(0, 2 * math.pi, size)
        elif kernel == "poly":
            self.terms = [(i, j, k) for i in range(p + 1) for j in range(i, p + 1) for k in range(j, p + 1)][1:]
        elif kernel != "linear":
            raise ValueError(f"no kernel {kernel!r}")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "rbf":
            return np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        if self.kernel == "poly":
            one = np.column_stack([np.ones(len(x)), x])
            return np.column_stack([one[:, i] * one[:, j] * one[:, k] for i, j, k in self.terms])
        return x


def summed(df: DataFrame, part, size: int) -> np.ndarray:
    """The sum of the arrays that `part` makes of batches, added on the cluster: a row for each place in the array comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += part(b)
        yield pd.DataFrame({"v": [total]})

    got = df.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def _ready(df: DataFrame, target: str, xs: list[str]) -> DataFrame:
    from .models import complete

    return _standard(complete(df, list(dict.fromkeys([target, *xs]))), list(dict.fromkeys([target, *xs])))


def support_vector_regression(df: DataFrame, target: str, xs: list[str], kernel: str = "rbf", c: float = 1.0, epsilon: float = 0.1, steps: int = 25, size: int = 200) -> DataFrame:
    """fid, svr_pred, svr_resid, svr_used: the epsilon-insensitive loss over a kernel's features, minimised by reweighted least squares, one pass a step."""
    raw = _ready(df, target, xs)
    z = stored(raw.select("fid", F.col(target).alias("t"), F.col(f"z_{target}").alias("y"), *(F.col(f"z_{x}").alias(f"x{i}") for i, x in enumerate(xs))))
    names, make = [f"x{i}" for i in range(len(xs))], Features(kernel, len(xs), size)
    d = make(np.zeros((1, len(xs)))).shape[1] + 1
    beta, n = np.zeros(d), z.count()

    def design(b: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(b)), make(b[names].to_numpy(dtype=float))])

    penalty = np.eye(d) / (2 * c)
    penalty[0, 0] = 1e-9
    for step in range(steps):

        def part(b: pd.DataFrame, beta=beta, first=step == 0) -> np.ndarray:
            x, y = design(b), b["y"].to_numpy(dtype=float)
            r = y - x @ beta
            over = np.maximum(0, np.abs(r) - epsilon)
            # |r| - epsilon is bounded by a square about its last value; within the tube nothing pulls
            w = np.where(first, 1.0, np.where(over > 0, 1 / (2 * np.maximum(over, 1e-3)), 0.0))
            goal = np.where(first, y, x @ beta + np.sign(r) * over)
            xw = x * w[:, None]
            return np.concatenate([(xw.T @ x).reshape(-1), xw.T @ goal])

        got = summed(z, part, d * d + d)
        new = np.linalg.solve(got[: d * d].reshape(d, d) + penalty + 1e-9 * n * np.eye(d), got[d * d :] + 1e-9 * n * beta)
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < 1e-5:
            break
    s = raw.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    mean, sd = s["m"], s["s"] or 1.0

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = design(b) @ beta * sd + mean
            yield pd.DataFrame({"fid": b["fid"], "svr_pred": p, "svr_resid": b["t"] - p, "svr_used": 1})

    got = z.mapInPandas(predict, "fid long, svr_pred double, svr_resid double, svr_used int")
    return df.select("fid").join(got, "fid", "left").fillna(0, ["svr_used"])


def support_vector_classification(df: DataFrame, target: str, xs: list[str], kernel: str = "rbf", c: float = 1.0, size: int = 100, steps: int = 50) -> DataFrame:
    """fid, svc_class, svc_conf, svc_used: linear machines on a kernel's features, one class against the rest; confidence is the winner's logistic margin."""
    from .models import complete

    ready = _standard(complete(df, xs).filter(F.col(target).isNotNull()), xs).withColumn("name", F.col(target).cast("string"))
    names = [r[0] for r in ready.select("name").distinct().orderBy("name").collect()]  # the classes
    if len(names) < 2:
        raise ValueError("the target has a single class")
    make = Features(kernel, len(xs), size)

    @F.pandas_udf("array<double>")
    def features(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(make(np.column_stack([v.to_numpy(dtype=float) for v in cols]))))

    z = stored(ready.select("fid", (F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1).cast("double").alias("label"), features(*(f"z_{x}" for x in xs)).alias("a")))
    z = z.withColumn("features", array_to_vector("a"))
    n = z.count()
    tool = mc.LinearSVC(maxIter=steps, regParam=1 / (2 * c * n))
    out = z.select("fid")
    margins = []
    for i in range(len(names) if len(names) > 2 else 1):
        k = i if len(names) > 2 else 1
        fit = tool.fit(z.withColumn("label", (F.col("label") == k).cast("double")))
        got = fit.transform(z.select("fid", "features")).select("fid", vector_to_array("rawPrediction")[1].alias(f"m{k}"))
        out = out.join(got, "fid")
        margins.append(k)
    if len(names) == 2:
        out = out.withColumn("m0", -F.col("m1"))
    m = F.array(*(F.col(f"m{k}") for k in range(len(names))))
    top = F.array_max(m)
    got = out.select("fid", F.element_at(F.array(*map(F.lit, names)), F.array_position(m, top).cast("int")).alias("svc_class"), (1 / (1 + F.exp(-top))).alias("svc_conf"), F.lit(1).alias("svc_used"))
    return df.select("fid").join(got, "fid", "left").fillna(0, ["svc_used"])


def _layers(flat: np.ndarray, shape: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(shape[:-1], shape[1:], strict=True):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers: list) -> list[np.ndarray]:
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
    return acts


def _local_adam(x: np.ndarray, y: np.ndarray, flat: np.ndarray, shape: list[int], epochs: int, rate: float, seed: int, batch: int = 200) -> np.ndarray:
    flat, rng = flat.copy(), np.random.default_rng(seed)
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            at, t = order[a : a + batch], t + 1
            layers = _layers(flat, shape)
            acts = _forward(x[at], layers)
            delta, grads = (acts[-1] - y[at, None]) / len(at), []
            for i in range(len(layers) - 1, -1, -1):
                grads[:0] = [(acts[i].T @ delta).reshape(-1), delta.sum(axis=0)]
                if i:
                    delta = (delta @ layers[i][0].T) * (acts[i] > 0)
            g = np.concatenate(grads) + 1e-4 * flat / max(1, len(x))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return flat


def mlp_regression(df: DataFrame, target: str, xs: list[str], hidden: tuple[int, ...] = (64, 32), steps: int = 1000, local: int = 25, rate: float = 1e-3, tolerance: float = 1e-4) -> DataFrame:
    """fid, mlp_pred, mlp_resid, mlp_used, mlp_rounds: a network of rectified units on standardised values.

    Each round every partition takes `local` epochs of Adam from the common weights, which become the mean of theirs, by
    rows (McMahan et al. 2017); at most steps / local rounds, fewer when the loss no longer falls.
    """
    raw = _ready(df, target, xs)
    z = stored(raw.select("fid", F.col(target).alias("t"), F.col(f"z_{target}").alias("y"), *(F.col(f"z_{x}").alias(f"x{i}") for i, x in enumerate(xs))))
    names, shape = [f"x{i}" for i in range(len(xs))], [len(xs), *hidden, 1]
    rng = np.random.default_rng(SEED)
    flat = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * math.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(shape[:-1], shape[1:], strict=True)])
    best, stale, rounds = math.inf, 0, 0
    for rounds in range(1, max(1, steps // local) + 1):
        sent = flat

        def train(batches: Iterator[pd.DataFrame], sent=sent, rounds=rounds) -> Iterator[pd.DataFrame]:
            # a task trains on what fits one batch at a time, so its memory is bounded
            for b in batches:
                if len(b):
                    x, y = b[names].to_numpy(dtype=float), b["y"].to_numpy(dtype=float)
                    loss = float(((_forward(x, _layers(sent, shape))[-1][:, 0] - y) ** 2).sum())
                    new = _local_adam(x, y, sent, shape, local, rate, SEED + rounds)
                    yield pd.DataFrame({"v": [np.concatenate([new * len(b), [loss, len(b)]])]})

        got = z.mapInPandas(train, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(len(flat) + 2)
        total[got["i"].to_numpy()] = got["v"].to_numpy()
        flat, loss = total[:-2] / total[-1], total[-2] / total[-1]
        stale = stale + 1 if loss > best - tolerance else 0
        best = min(best, loss)
        if stale >= 3:
            break
    s = raw.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    mean, sd = s["m"], s["s"] or 1.0

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = _forward(b[names].to_numpy(dtype=float), _layers(flat, shape))[-1][:, 0] * sd + mean
            yield pd.DataFrame({"fid": b["fid"], "mlp_pred": p, "mlp_resid": b["t"] - p, "mlp_used": 1, "mlp_rounds": rounds})

    got = z.mapInPandas(predict, "fid long, mlp_pred double, mlp_resid double, mlp_used int, mlp_rounds int")
    return df.select("fid").join(got, "fid", "left").fillna(0, ["mlp_used"])
