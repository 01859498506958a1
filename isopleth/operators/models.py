"""Regressions. The cluster sums Gram matrices in one pass each; the driver solves systems of a few columns."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.dist import two_sided
from ..layer import K, Statement, clean_numeric, pts, reg
from ..plans import neighbours, spectrum
from ..plans.gram import gram, predict
from ..plans.store import stored


def _p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _terms(spark: SparkSession, names: list[str], beta, se) -> DataFrame:
    rows = [(n, float(b), float(s), float(b / s) if s else 0.0, _p(b / s) if s else 1.0) for n, b, s in zip(names, beta, se, strict=True)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")


def centred(df: DataFrame, cols: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, sums of products of deviations) of complete columns, in two passes, so that large means don't cancel."""
    r = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).first()
    if not r["n"]:
        raise ValueError("no complete rows")
    mean = np.array([r[f"m{i}"] for i in range(len(cols))], dtype=float)
    return float(r["n"]), mean, gram(df, [F.col(c) - float(v) for c, v in zip(cols, mean, strict=True)])


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    return df.withColumns({c: clean_numeric(F.col(c)) for c in cols}).dropna(subset=cols)


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Coefficients, standard errors, R2 and its kin; rows with missing values don't take part."""
    n, mean, m = centred(complete(df, [y, *xs]), [*xs, y])
    p = len(xs)
    k = p + 1
    if n <= k:
        raise ValueError("too few complete rows")
    inv = np.linalg.pinv(m[:p, :p])
    slopes = inv @ m[:p, p]
    tss = m[p, p]
    rss = max(0.0, tss - slopes @ m[:p, p])
    beta = np.concatenate([[mean[p] - slopes @ mean[:p]], slopes])
    s2 = rss / (n - k)
    # the inverse for the columns with the intercept, from that of the centred ones
    whole = np.zeros((k, k))
    whole[1:, 1:] = inv
    whole[0, 1:] = whole[1:, 0] = -inv @ mean[:p]
    whole[0, 0] = 1 / n + mean[:p] @ inv @ mean[:p]
    r2 = 1 - rss / tss if tss else 0.0
    aicc = n * math.log(max(rss, 1e-300) / n) + 2 * (k + 1) + 2 * (k + 1) * (k + 2) / max(1.0, n - k - 2)
    return {"beta": beta, "se": np.sqrt(np.maximum(0, s2 * np.diag(whole))), "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "rss": rss, "tss": tss, "s2": s2, "n": int(n), "aicc": aicc, "inv": whole}


def ols_terms(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    fit = ols(df, y, xs)
    return _terms(df.sparkSession, ["intercept", *xs], fit["beta"], fit["se"])


def ols_output(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """fid, residual, std_res of every row; NULL where a value is missing."""
    fit = ols(df, y, xs)
    got = complete(df, [y, *xs]).select("fid", (F.col(y) - predict(xs, fit["beta"])).alias("residual"))
    sd = math.sqrt(fit["s2"])
    return df.select("fid").join(got.withColumn("std_res", F.col("residual") / sd if sd else F.lit(0.0)), "fid", "left")


def ols_report(df: DataFrame, y: str, xs: list[str], edges: DataFrame | None = None) -> DataFrame:
    """One row: fit, Jarque-Bera, Koenker's Breusch-Pagan, and the residuals' Moran statistic (e'We / e'e) over edges (src, dst, w)."""
    fit = ols(df, y, xs)
    d = stored(complete(df, [y, *xs]).select("fid", *xs, (F.col(y) - predict(xs, fit["beta"])).alias("e")).withColumn("g", F.col("e") * F.col("e")))
    n, e = fit["n"], F.col("e")
    r = d.agg(F.sum(e**3).alias("e3"), F.sum(e**4).alias("e4")).first()
    v = fit["rss"] / n
    jb = n / 6 * ((r["e3"] / n / v**1.5) ** 2 + 0.25 * (r["e4"] / n / v**2 - 3) ** 2) if v > 0 else 0.0
    bp = n * ols(d, "g", xs)["r2"] if v > 0 else 0.0
    i = None
    if edges is not None and v > 0:
        at = edges.join(d.select(F.col("fid").alias("src"), F.col("e").alias("ei")), "src").join(d.select(F.col("fid").alias("dst"), F.col("e").alias("ej")), "dst")
        i = (at.agg(F.sum(F.col("w") * F.col("ei") * F.col("ej"))).first()[0] or 0.0) / fit["rss"]
    row = (n, fit["r2"], fit["adj_r2"], fit["aicc"], math.sqrt(fit["s2"]), jb, dist.chi2_tail(jb, 2), bp, dist.chi2_tail(bp, len(xs)), i)
    return df.sparkSession.createDataFrame([tuple(None if x is None else int(x) if j == 0 else float(x) for j, x in enumerate(row))], "n long, r2 double, adj_r2 double, aicc double, sigma double, jarque_bera double, jarque_bera_p double, breusch_pagan double, breusch_pagan_p double, residual_moran double")


def exploratory(df: DataFrame, y: str, xs: list[str], most: int = 3) -> DataFrame:
    """All subsets of up to `most` predictors (5 at most) from one matrix of centred products, by AICc: fit, the largest p-value of a term and the largest VIF."""
    n, _, m = centred(complete(df, [y, *xs]), [*xs, y])
    end, rows = len(xs), []
    for size in range(1, min(most, 5, len(xs)) + 1):
        for at in itertools.combinations(range(len(xs)), size):
            xx, xy = m[np.ix_(at, at)], m[list(at), end]
            inv = np.linalg.pinv(xx)
            beta, tss, k = inv @ xy, m[end, end], size + 1
            rss = max(0.0, tss - beta @ xy)
            se = np.sqrt(np.maximum(1e-300, rss / max(1.0, n - k) * np.diag(inv)))
            r2 = float(1 - rss / tss) if tss else 0.0
            rows.append((",".join(xs[i] for i in at), size, r2, 1 - (1 - r2) * (n - 1) / max(1.0, n - k), float(n * math.log(max(rss, 1e-300) / n) + 2 * (k + 1) + 2 * (k + 1) * (k + 2) / max(1.0, n - k - 2)), max(_p(z) for z in beta / se), float(np.max(np.diag(inv) * np.diag(xx)))))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r[4], r[0])), "variables string, size int, r2 double, adj_r2 double, aicc double, max_p double, max_vif double")


def _glr_fit(df: DataFrame, y: str, xs: list[str], family: str, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, Column, int, bool]:
    """(beta, standard errors, mean as a column, iterations, whether it converged) over complete rows."""
    bad = {"logistic": ~F.col(y).isin(0, 1), "poisson": (F.col(y) < 0) | (F.col(y) != F.floor(y))}.get(family)
    if bad is not None and df.filter(bad).limit(1).count():
        raise ValueError({"logistic": "the target must be binary", "poisson": "the target must be a count"}[family])
    if family == "gaussian":
        fit = ols(df, y, xs)
        return fit["beta"], fit["se"], predict(xs, fit["beta"]), 1, True
    cols, k = [F.lit(1.0), *(F.col(x) for x in xs)], len(xs) + 1
    limit = 35.0 if family == "logistic" else 30.0

    def mean(b: np.ndarray) -> tuple[Column, Column]:
        eta = F.greatest(F.lit(-limit), F.least(F.lit(limit), predict(xs, b)))
        return eta, 1 / (1 + F.exp(-eta)) if family == "logistic" else F.exp(eta)

    beta, step, converged = np.zeros(k), 0, False
    for step in range(1, steps + 1):
        eta, mu = mean(beta)
        w = F.greatest(mu * (1 - mu) if family == "logistic" else mu, F.lit(1e-10))
        m = gram(df, [*cols, eta + (F.col(y) - mu) / w], w)
        new = np.linalg.pinv(m[:k, :k]) @ m[:k, k]
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < tolerance:
            converged = True
            break
    return beta, np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(m[:k, :k])))), mean(beta)[1], step, converged


def glr(df: DataFrame, y: str, xs: list[str], family: str, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Gaussian, logistic or Poisson regression by reweighted least squares: one weighted Gram aggregate a step."""
    df = stored(complete(df, [y, *xs]).select(y, *xs))
    beta, se, *_ = _glr_fit(df, y, xs, family, steps, tolerance)
    return _terms(df.sparkSession, ["intercept", *xs], beta, se)


def glr_output(df: DataFrame, y: str, xs: list[str], family: str, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """fid, glr_fit, glr_resid, glr_used of every row; NULL and 0 where a value is missing."""
    ready = stored(complete(df, [y, *xs]).select("fid", y, *xs))
    mu = _glr_fit(ready, y, xs, family, steps, tolerance)[2]
    got = ready.select("fid", mu.alias("glr_fit"), (F.col(y) - mu).alias("glr_resid"), F.lit(1).alias("glr_used"))
    return df.select("fid").join(got, "fid", "left").fillna(0, ["glr_used"])


def glr_report(df: DataFrame, y: str, xs: list[str], family: str, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """One row: log-likelihood, deviance, that of the mean alone, pseudo R2, AIC, iterations, convergence."""
    d = stored(complete(df, [y, *xs]).select(y, *xs))
    _, _, mu, step, converged = _glr_fit(d, y, xs, family, steps, tolerance)
    v, k = F.col(y), len(xs) + 1
    n, avg = d.agg(F.count("*"), F.avg(y)).first()

    def parts(m: Column) -> tuple[Column, Column]:
        """log-likelihood and deviance of a row; the gaussian's come from its sum of squares"""
        if family == "logistic":
            m = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), m))
            ll = v * F.log(m) + (1 - v) * F.log(1 - m)
            return ll, -2 * ll
        if family == "poisson":
            ll = v * F.log(m) - m - dist.lgamma(v + 1)
            return ll, 2 * (F.when(v > 0, v * F.log(v / m)).otherwise(0.0) - (v - m))
        return (v - m) * (v - m), (v - m) * (v - m)

    (l1, d1), (l0, d0) = parts(mu), parts(F.lit(float(avg)))
    r = d.agg(*(F.sum(c).alias(x) for x, c in (("l1", l1), ("d1", d1), ("l0", l0), ("d0", d0)))).first()
    ll = -n / 2 * (math.log(2 * math.pi * max(r["l1"], 1e-300) / n) + 1) if family == "gaussian" else r["l1"]
    row = (family, int(n), float(ll), float(r["d1"]), float(r["d0"]), 1 - r["d1"] / r["d0"] if r["d0"] else 0.0, -2 * ll + 2 * (k + (family == "gaussian")), step, converged)
    return df.sparkSession.createDataFrame([row], "family string, n long, log_likelihood double, deviance double, null_deviance double, pseudo_r2 double, aic double, iterations int, converged boolean")


def quantile(df: DataFrame, y: str, xs: list[str], tau: float = 0.5, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Quantile regression by reweighted least squares on the pinball loss; each row says after how many steps it ended and whether it converged."""
    df = stored(complete(df, [y, *xs]).select(y, *xs))
    k = len(xs) + 1
    beta, step, converged = ols(df, y, xs)["beta"], 0, False
    for step in range(1, steps + 1):
        r = F.col(y) - predict(xs, beta)
        m = gram(df, [F.lit(1.0), *(F.col(x) for x in xs), F.col(y)], F.when(r >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(r), F.lit(1e-6)))
        new = np.linalg.pinv(m[:k, :k]) @ m[:k, k]
        moved, beta = float(np.abs(new - beta).max()), new
        if moved < tolerance:
            converged = True
            break
    return df.sparkSession.createDataFrame([(n, float(b), step, converged) for n, b in zip(["intercept", *xs], beta, strict=True)], "term string, estimate double, iterations int, converged boolean")


def regimes(df: DataFrame, y: str, xs: list[str], regime: str) -> DataFrame:
    """Coefficients for each regime, from one grouped Gram aggregate, with the joint Chow (Wald) statistic."""
    cols = [F.lit(1.0), *(F.col(x) for x in xs), F.col(y)]
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    found = df.dropna(subset=[y, *xs, regime]).groupBy(regime).agg(*(F.sum(cols[i] * cols[j]).alias(f"g{n}") for n, (i, j) in enumerate(at))).orderBy(regime).collect()  # a row for each regime
    if len(found) < 2:
        raise ValueError("two regimes at least")
    k, fits, total, rss = len(xs) + 1, [], 0.0, 0.0
    for row in found:
        m = np.zeros((k + 1, k + 1))
        for n, (i, j) in enumerate(at):
            m[i, j] = m[j, i] = row[n + 1]
        inv = np.linalg.pinv(m[:k, :k])
        b = inv @ m[:k, k]
        rss += m[k, k] - b @ m[:k, k]
        total += m[0, 0]
        fits.append((row[0], b, inv))
    s2 = rss / (total - k * len(fits))
    base, wald_d, wald_v = fits[0], [], []
    for _, b, inv in fits[1:]:
        wald_d.append(b - base[1])
        wald_v.append(s2 * inv)
    d, r = np.concatenate(wald_d), len(fits) - 1
    v = np.kron(np.ones((r, r)), s2 * base[2])
    for i, x in enumerate(wald_v):
        v[i * k : (i + 1) * k, i * k : (i + 1) * k] += x
    chow = float(d @ np.linalg.pinv(v) @ d)
    rows = [(str(g), n, float(b), float(math.sqrt(max(0, s2 * inv[i, i]))), chow) for g, beta, inv in fits for i, (n, b) in enumerate(zip(["intercept", *xs], beta, strict=True))]
    return df.sparkSession.createDataFrame(rows, "regime string, term string, estimate double, std_error double, chow double")


def lagged(df: DataFrame, edges: DataFrame, cols: list[str]) -> DataFrame:
    """df (fid, ...) with w_<column>, the weighted mean of the neighbours' values; 0 without neighbours."""
    lag = edges.join(df.select(F.col("fid").alias("dst"), *cols), "dst").groupBy("src").agg(*(F.sum(F.col("w") * F.col(c)).alias(f"w_{c}") for c in cols)).withColumnRenamed("src", "fid")
    return df.join(lag, "fid", "left").fillna(0.0, [f"w_{c}" for c in cols])


def lm_diagnostics(df: DataFrame, edges: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Lagrange multiplier tests for a spatial lag and a spatial error, plain and robust."""
    fit = ols(df, y, xs)
    beta, n, k = fit["beta"], fit["n"], len(xs) + 1
    d = df.select("fid", y, *xs, (F.col(y) - predict(xs, beta)).alias("e"), predict(xs, beta).alias("f"))
    d = lagged(d, edges, ["e", "f", y])
    cols = [F.lit(1.0), *(F.col(x) for x in xs), F.col("e"), F.col("w_e"), F.col(f"w_{y}"), F.col("w_f")]
    m = gram(d, cols)
    e, we, wy, wf = k, k + 1, k + 2, k + 3
    s2 = m[e, e] / n
    t = edges.alias("a").join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v")), ["src", "dst"], "left").agg(F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("v", F.lit(0.0)))).first()[0]
    if s2 <= 0 or not t or t <= 0:
        raise ValueError("no residual variance or no links")
    de, dl = m[e, we] / s2, m[e, wy] / s2
    xw = m[:k, wf]
    D = (m[wf, wf] - xw @ np.linalg.pinv(m[:k, :k]) @ xw) / s2 + t
    D = D if D > t else 1.0001 * t
    lag, err = dl**2 / D, de**2 / t
    rlag, rerr = (dl - de) ** 2 / (D - t), (de - t / D * dl) ** 2 / (t * (1 - t / D))
    rows = [("LM-lag", lag, 1), ("LM-error", err, 1), ("Robust LM-lag", rlag, 1), ("Robust LM-error", rerr, 1), ("SARMA", err + rlag, 2)]
    return df.sparkSession.createDataFrame([(a, float(b), math.erfc(math.sqrt(max(0, b) / 2)) if c == 1 else math.exp(-b / 2)) for a, b, c in rows], "test string, statistic double, p_value double")


def durbin(df: DataFrame, edges: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Spatial Durbin model by two-stage least squares, instruments the lags of the lags."""
    d = lagged(lagged(df.select("fid", y, *xs), edges, [y, *xs]), edges, [f"w_{x}" for x in xs])
    names = ["intercept", *xs, *(f"W_{x}" for x in xs), "rho"]
    z = [F.lit(1.0), *(F.col(x) for x in xs), *(F.col(f"w_{x}") for x in xs), F.col(f"w_{y}")]
    h = [*z[:-1], *(F.col(f"w_w_{x}") for x in xs)]
    m = gram(d, [*h, z[-1], F.col(y)])
    q, k = len(h), len(z)
    hh, hz, hy = m[:q, :q], np.concatenate([m[:q, : k - 1], m[:q, q : q + 1]], axis=1), m[:q, q + 1]
    inv = np.linalg.pinv(hh)
    a = np.linalg.pinv(hz.T @ inv @ hz)
    b = a @ hz.T @ inv @ hy
    at = [*range(k - 1), q]
    rss = m[q + 1, q + 1] - 2 * b @ m[at, q + 1] + b @ m[np.ix_(at, at)] @ b
    return _terms(df.sparkSession, names, b, np.sqrt(np.maximum(0, np.diag(a) * rss / (m[0, 0] - k))))


def _log_determinant(edges: DataFrame, ids: DataFrame, n: int, most: int, powers: int = 30, vectors: int = 24) -> Callable[[float], float]:
    """log |I - p W| as a function of p: from the eigenvalues for up to `most` features, else from traces of W's powers,
    estimated with hashed vectors of signs (Barry and Pace 1999), one edge join a power; the first two traces are exact."""
    if n <= most:
        at = {f: i for i, f in enumerate(sorted(r[0] for r in ids.select("fid").collect()))}  # at most `most` features
        w = np.zeros((n, n))
        for r in edges.collect():  # and their links
            w[at[r["src"]], at[r["dst"]]] = r["w"]
        ev = np.linalg.eigvals(w)
        return lambda p: float(np.log(np.abs(1 - p * ev)).sum())
    names = [f"v{i}" for i in range(vectors)]
    v = stored(ids.select("fid", *(F.when(F.pmod(F.xxhash64("fid", F.lit(i)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias(c) for i, c in enumerate(names))))
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("b"))
    traces, now = [0.0, float(edges.join(back, ["src", "dst"]).agg(F.sum(F.col("w") * F.col("b"))).first()[0] or 0.0)], v
    for k in range(1, powers + 1):
        step = edges.join(now.withColumnRenamed("fid", "dst"), "dst").groupBy(F.col("src").alias("fid")).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in names))
        now = stored(ids.select("fid").join(step, "fid", "left").fillna(0.0, names))
        if k > 2:
            both = now.join(v.select("fid", *(F.col(c).alias(f"o_{c}") for c in names)), "fid")
            traces.append(float(both.agg(F.sum(sum((F.col(c) * F.col(f"o_{c}") for c in names), F.lit(0.0)))).first()[0]) / vectors)
    return lambda p: -sum(t * p**k / k for k, t in enumerate(traces, 1))


def spatial_ml(df: DataFrame, edges: DataFrame, y: str, xs: list[str], kind: str = "lag", most: int = 5_000) -> DataFrame:
    """Maximum likelihood for the spatial lag (rho) or error (lambda) model on the concentrated likelihood.

    Moments are summed on the cluster; each trial value costs algebra of a few columns. The log-determinant comes from
    the weights' eigenvalues for up to `most` features, beyond from estimated traces.
    """
    df = stored(complete(df.select("fid", y, *xs), [y, *xs]))
    edges = stored(neighbours.restricted(edges, df))
    d = lagged(df, edges, [y, *xs])
    k = len(xs) + 1
    w1 = F.when(F.col("fid").isNotNull(), 1.0)
    ones = edges.groupBy(F.col("src").alias("fid")).agg(F.sum("w").alias("w_1"))
    d = d.join(ones, "fid", "left").fillna(0.0, ["w_1"])
    base = [w1, *(F.col(x) for x in xs), F.col(y)]
    lags = [F.col("w_1"), *(F.col(f"w_{x}") for x in xs), F.col(f"w_{y}")]
    m = gram(d, base + lags)
    n = m[0, 0]
    log_det = _log_determinant(edges, df, int(n), most)

    def moments(p: float) -> np.ndarray:
        t = np.concatenate([np.eye(k + 1), -p * np.eye(k + 1)])
        if kind == "lag":  # only y is filtered
            t[k + 1 : 2 * k + 1, :k] = 0
        return t.T @ m @ t

    def loss(p: float) -> float:
        g = moments(p)
        rss = g[k, k] - g[:k, k] @ np.linalg.pinv(g[:k, :k]) @ g[:k, k]
        return n / 2 * math.log(max(rss, 1e-300) / n) - log_det(p)

    low, high, ratio = -0.99, 0.99, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    p = (low + high) / 2
    g = moments(p)
    inv = np.linalg.pinv(g[:k, :k])
    beta = inv @ g[:k, k]
    s2 = (g[k, k] - beta @ g[:k, k]) / n
    rows = [(t, float(v), float(math.sqrt(max(0, s2 * inv[i, i])))) for i, (t, v) in enumerate(zip(["intercept", *xs], beta, strict=True))] + [("rho" if kind == "lag" else "lambda", p, float("nan"))]
    return df.sparkSession.createDataFrame([(a, b, None if c != c else c) for a, b, c in rows], "term string, estimate double, std_error double")


def kernel_pairs(df: DataFrame, bandwidth: float, kernel: str) -> DataFrame:
    """src, dst, w of all pairs with a positive weight, each place with itself included.

    `adaptive_bisquare`: bandwidth counts places, the own one included; if that many share a place, only they weigh.
    `fixed_bisquare`, `fixed_gaussian`: a distance. The gaussian ends where its weight falls under 1e-12.
    """
    own = neighbours.points(df).select(F.col("fid").alias("src"), F.col("fid").alias("dst"), F.lit(0.0).alias("d2"))
    if kernel == "adaptive_bisquare":
        near = stored(neighbours.nearest(df, int(bandwidth) - 1).select("src", "dst", "d2"))
        pairs = near.unionByName(own).join(near.groupBy("src").agg(F.max("d2").alias("b2")), "src")
        return pairs.withColumn("w", F.when(F.col("b2") == 0, 1.0).otherwise((1 - F.col("d2") / F.col("b2")) ** 2)).filter("w > 0").select("src", "dst", "w")
    if kernel == "fixed_bisquare":
        w = (1 - F.col("d2") / float(bandwidth) ** 2) ** 2
        return neighbours.within(df, bandwidth).filter(F.col("d2") < float(bandwidth) ** 2).unionByName(own).select("src", "dst", w.alias("w"))
    if kernel == "fixed_gaussian":
        w = F.exp(-0.5 * F.col("d2") / float(bandwidth) ** 2)
        return neighbours.within(df, bandwidth * math.sqrt(2 * math.log(1e12))).unionByName(own).select("src", "dst", w.alias("w"))
    raise ValueError(f"no kernel {kernel!r}")


def gwr(df: DataFrame, y: str, xs: list[str], bandwidth: float = 30, kernel: str = "adaptive_bisquare") -> DataFrame:
    """Geographically weighted regression: Gram sums for each place, solved in batches.

    fid, y_observed, y_predicted, residual, local_r2, support, hat, and coef_, se_, t_ of intercept and predictors, for
    every row; NULL where a value or the place is missing.
    """
    ready = stored(complete(df, ["x", "y", *xs] if y == "y" else ["x", "y", y, *xs]))
    p = len(xs) + 1
    vals = ready.select(F.col("fid").alias("dst"), F.lit(1.0).alias("c0"), *(F.col(c).alias(f"c{i + 1}") for i, c in enumerate([*xs, y])))
    at = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = kernel_pairs(ready, bandwidth, kernel).join(vals, "dst").groupBy("src").agg(F.array(*(F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in at)).alias("g"), F.count_if(F.col("w") > 1e-12).alias("support"))
    names = ["int", *xs]
    made = [*(f"{a}_{x}" for a in ("coef", "se", "t") for x in names), "local_r2", "hat"]

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for v, row in zip(g, own, strict=True):
            m = np.zeros((p + 1, p + 1))
            for (i, j), x in zip(at, v, strict=True):
                m[i, j] = m[j, i] = x
            inv = np.linalg.pinv(m[:p, :p])
            b = inv @ m[:p, p]
            rss = max(0.0, m[p, p] - 2 * b @ m[:p, p] + b @ m[:p, :p] @ b)
            tss = m[p, p] - m[0, p] ** 2 / m[0, 0]
            free = m[0, 0] - p
            se = np.sqrt(np.maximum(0, rss / free * np.diag(inv))) if free > 0 else np.zeros(p)
            t = np.divide(b, se, out=np.zeros(p), where=se > 0)
            x = np.asarray(row)
            out.append(np.concatenate([b, se, t, [1 - rss / tss if tss > 0 else 1.0, x @ inv @ x]]))
        return pd.Series(out)

    own = ready.select("fid", F.col(y).alias("y_observed"), F.array(F.lit(1.0), *xs).alias("own"))
    solved = sums.withColumnRenamed("src", "fid").join(own, "fid").withColumn("b", solve("g", "own"))
    fitted = sum((F.col("b")[i] * F.col("own")[i] for i in range(1, p)), F.col("b")[0])
    got = solved.select("fid", "y_observed", fitted.alias("y_predicted"), (F.col("y_observed") - fitted).alias("residual"), "support", *(F.col("b")[i].alias(c) for i, c in enumerate(made)))
    return df.select("fid").join(got, "fid", "left")


def gwr_report(output: DataFrame) -> DataFrame:
    """One row of a GWR output: n, rss, r2, effective parameters, AICc."""
    s = output.dropna(subset=["residual"]).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("residual") ** 2).alias("rss"), F.var_pop("y_observed").alias("v"), F.sum("hat").alias("tr"))
    n, tr = F.col("n"), F.when(F.col("tr") > 0, F.col("tr")).otherwise(F.lit(1.0))
    aicc = n * F.log(F.col("rss") / n) + n * math.log(2 * math.pi) + n * (n + tr) / (n - 2 - tr)
    return s.select(n.cast("long").alias("n"), "rss", (1 - F.col("rss") / (n * F.col("v"))).alias("r2"), tr.alias("effective_parameters"), F.when((n - tr - 2 > 0) & (F.col("rss") > 0), aicc).alias("aicc"))


def mgwr(df: DataFrame, y: str, xs: list[str], candidates: tuple[int, ...] = (), steps: int = 12, tolerance: float = 1e-4) -> tuple[DataFrame, dict[str, int]]:
    """Multiscale GWR by backfitting (Fotheringham, Yang and Kang 2017): each term has its own adaptive bandwidth.

    (fid, mgwr_pred, mgwr_resid, mgwr_used, mg_b0 and mg_<predictor>; bandwidths). Values are standardised, as usual. A pass
    over the pairs scores all candidate bandwidths of a term by AICc; they are settled in the first three rounds.
    """
    ready = complete(df, [*dict.fromkeys(["x", "y", y, *xs])])
    n = ready.count()
    if n < 40 + 2 * (len(xs) + 1):
        raise ValueError("too few complete rows")
    if not candidates:
        low = 40 + 2 * (len(xs) + 1)
        candidates = tuple(dict.fromkeys(min(n, int(low * 2 ** (i / 2))) for i in range(7)))
    m = ready.agg(*(f(c).alias(f"{k}_{c}") for c in {y, *xs} for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scale = {c: (m[f"m_{c}"], m[f"s_{c}"] or 1.0) for c in {y, *xs}}
    z = {c: (F.col(c) - scale[c][0]) / scale[c][1] for c in scale}
    near = neighbours.nearest(ready, max(candidates) - 1)
    own = neighbours.points(ready).select(F.col("fid").alias("src"), F.col("fid").alias("dst"), F.lit(0.0).alias("d2"))
    reach = near.groupBy("src").agg(*(F.max(F.when(F.col("r") <= k - 1, F.col("d2"))).alias(f"b{k}") for k in candidates))
    pairs = stored(near.select("src", "dst", "d2").unionByName(own).join(reach, "src"))
    terms = ["b0", *xs]
    start = ols(ready.select(*(z[c].alias(c) for c in scale)), y, xs)["beta"]
    value = {"b0": F.lit(1.0), **{x: z[x] for x in xs}}
    state = ready.select("fid", z[y].alias("t"), *(value[j].cast("double").alias(f"x_{j}") for j in terms))
    state = stored(state.withColumns({f"f_{j}": F.col(f"x_{j}") * float(b) for j, b in zip(terms, start, strict=True)} | {f"c_{j}": F.lit(float(b)) for j, b in zip(terms, start, strict=True)}))
    chosen: dict[str, int] = {}
    for step in range(steps):
        before = state
        for j in terms:
            rest = F.col("t") - sum((F.col(f"f_{i}") for i in terms if i != j), F.lit(0.0))
            v = state.select(F.col("fid").alias("dst"), F.col(f"x_{j}").alias("x"), rest.alias("r"))
            tried = candidates if step < 3 else (chosen[j],)
            w = {k: F.when(F.col(f"b{k}") == 0, (F.col("d2") == 0).cast("double")).when(F.col("d2") < F.col(f"b{k}"), (1 - F.col("d2") / F.col(f"b{k}")) ** 2).otherwise(0.0) for k in tried}
            sums = pairs.join(v, "dst").groupBy("src").agg(*(F.sum(w[k] * F.col("x") * F.col(a)).alias(f"{a}{k}") for k in tried for a in ("x", "r")))
            got = stored(sums.withColumnRenamed("src", "fid").join(v.withColumnRenamed("dst", "fid"), "fid"))
            fit = {k: F.when(F.col(f"x{k}") > 0, F.col(f"r{k}") / F.col(f"x{k}")).otherwise(0.0) for k in tried}
            if len(tried) > 1:
                s = got.agg(*(F.sum((F.col("r") - F.col("x") * fit[k]) ** 2).alias(f"s{k}") for k in tried), *(F.sum(F.when(F.col(f"x{k}") > 0, F.col("x") ** 2 / F.col(f"x{k}"))).alias(f"t{k}") for k in tried)).first()
                chosen[j] = min(tried, key=lambda k: n * math.log(max(s[f"s{k}"], 1e-300) / n) + n * (n + s[f"t{k}"]) / max(1e-9, n - 2 - s[f"t{k}"]))
            k = chosen.setdefault(j, tried[0])
            state = stored(state.drop(f"f_{j}", f"c_{j}").join(got.select("fid", (F.col("x") * fit[k]).alias(f"f_{j}"), fit[k].alias(f"c_{j}")), "fid"))
        moved = state.alias("a").join(before.alias("b"), "fid").agg(F.sum(sum(((F.col(f"a.f_{j}") - F.col(f"b.f_{j}")) ** 2 for j in terms), F.lit(0.0))).alias("d"), F.sum(sum((F.col(f"a.f_{j}") ** 2 for j in terms), F.lit(0.0))).alias("s")).first()
        if step >= 3 and moved["d"] <= tolerance**2 * max(moved["s"], 1e-12):
            break
    my, sy = scale[y]
    fitted = sum((F.col(f"f_{j}") for j in terms), F.lit(0.0)) * sy + my
    got = state.select("fid", fitted.alias("mgwr_pred"), ((F.col("t") * sy + my) - fitted).alias("mgwr_resid"), F.lit(1).alias("mgwr_used"), F.col("c_b0").alias("mg_b0"), *(F.col(f"c_{x}").alias(f"mg_{x}") for x in xs))
    return df.select("fid").join(got, "fid", "left").fillna(0, ["mgwr_used"]), chosen


def esf(df: DataFrame, edges: DataFrame, y: str, xs: list[str], most_vectors: int = 10, most: int = 400_000, dense: int = 5_000) -> DataFrame:
    """Eigenvector spatial filtering: fid, residual, fitted, spatial_filter. Moran eigenvectors with positive eigenvalues join one by one, the
    one most correlated with the residuals first, until their Moran p-value is 0.1 or more, or most_vectors have joined.

    Features and links are held on the driver, so layers of more than `most` features raise an error. The eigenvectors come from a dense
    matrix up to `dense` features; beyond, each one that joins is found among all of them by Lanczos steps from the residuals.
    """
    ready = complete(df.select("fid", *dict.fromkeys([y, *xs])), [*dict.fromkeys([y, *xs])])
    table = ready.select("fid", F.col(y).cast("double").alias("v0"), *(F.col(x).cast("double").alias(f"v{i}") for i, x in enumerate(xs, 1))).limit(most + 1).toArrow()  # at most `most` features
    if table.num_rows > most:
        raise ValueError(f"the filter takes up to {most} features")
    table = table.sort_by("fid")
    fids, n = table["fid"].to_numpy(), table.num_rows
    t = table["v0"].to_numpy()
    design = np.column_stack([np.ones(n), *(table[f"v{i}"].to_numpy() for i in range(1, len(xs) + 1))])
    links = neighbours.restricted(edges, ready).select("src", "dst", "w").toArrow()  # theirs
    w = spectrum.Centred(n, *(np.searchsorted(fids, links[c].to_numpy()) for c in ("src", "dst")), links["w"].to_numpy())
    pool = vector = leading = None
    picked: list[np.ndarray] = []
    s1, s2, s0 = 2 * (w.values**2).sum(), (w.sums**2).sum(), w.total
    while True:
        full = np.column_stack([design, *picked])
        beta = np.linalg.lstsq(full, t, rcond=None)[0]
        e = t - full @ beta
        z = e - e.mean()
        i = n / s0 * (z @ w.plain(z)) / (z @ z) if z @ z > 0 and s0 > 0 else 0.0
        kurt = n * (z**4).sum() / (z @ z) ** 2 if z @ z > 0 else 3.0
        var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - kurt * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - 1 / (n - 1) ** 2 if n > 3 and s0 > 0 else 0.0
        p = _p((i + 1 / (n - 1)) / math.sqrt(var)) if var > 0 else 1.0
        if p >= 0.1 or len(picked) >= most_vectors:
            break
        if n > dense:
            best = leading.best(z, picked) if leading else None
            if best is None:
                leading = spectrum.Leading(df.sparkSession, w, z, design, most_vectors - len(picked))
                best = leading.best(z, picked)
            if best is None:
                break
            picked.append(best)
            continue
        if pool is None:
            value, vector = np.linalg.eigh(w.dense())
            pool = [j for j in np.argsort(-value) if value[j] > 1e-10]
        if not pool:
            break
        best = max(pool, key=lambda j: abs(vector[:, j] @ z))
        pool.remove(best)
        picked.append(vector[:, best])
    part = np.column_stack(picked) @ beta[design.shape[1] :] if picked else np.zeros(n)
    got = df.sparkSession.createDataFrame(pa.table({"fid": pa.array(fids, pa.int64()), "residual": e, "fitted": t - e, "spatial_filter": part}))
    return df.select("fid").join(got, "fid", "left")


_OLS_SQL = f"""m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x1) AS mx, avg(y) AS my, var_pop(x1) AS vx, var_pop(y) AS vy, avg(x1 * y) - avg(x1) * avg(y) AS cxy FROM {{reg}}),
b AS (SELECT *, cxy / vx AS b1, my - cxy / vx * mx AS b0, n * (vy - cxy * cxy / vx) / (n - 2) AS s2 FROM m), s AS (SELECT *, sqrt(s2 / (n * vx)) AS se FROM b)
SELECT round(b0, 4) AS intercept, round(b1, 5) AS slope, round(se, 6) AS slope_se, round(b1 / se, 3) AS z, round({two_sided('b1 / se')}, 6) AS p_value, round(cxy * cxy / (vx * vy), 8) AS r2 FROM s"""
_COMPARE = """p AS (SELECT y, 1 AS model, (SELECT avg(y) FROM {reg}) AS f FROM {reg} UNION ALL SELECT y, 2, x1 * (SELECT sum(x1 * y) / sum(x1 * x1) FROM {reg}) FROM {reg}),
m AS (SELECT model, sqrt(avg((y - f) * (y - f))) AS rmse, avg(abs(y - f)) AS mae, avg(f - y) AS bias, 1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y)) AS r2 FROM p GROUP BY model),
s AS (SELECT *, 0.45D * rmse / max(rmse) OVER () + 0.25D * mae / max(mae) OVER () + 0.25D AS score FROM m)
SELECT model, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(r2, 6) AS r2, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score, model) AS INT) AS rank FROM s"""
_AUDIT = """s AS (SELECT count(*) AS n, count(y) AS valid, min(y) AS lo, max(y) AS hi, avg(y) AS mean, stddev_pop(y) AS sd, percentile_cont(0.25) WITHIN GROUP (ORDER BY y) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY y) AS q2, percentile_cont(0.75) WITHIN GROUP (ORDER BY y) AS q3, count(DISTINCT y) AS distinct_n FROM {reg}),
o AS (SELECT sum(CASE WHEN y < q1 - 1.5D * (q3 - q1) OR y > q3 + 1.5D * (q3 - q1) THEN 1 ELSE 0 END) AS outliers, avg((y - mean) * (y - mean) * (y - mean)) / max(sd * sd * sd) AS skew FROM {reg} CROSS JOIN s)
SELECT CAST(n AS BIGINT) AS n, CAST(n - valid AS BIGINT) AS missing, round(lo, 4) AS min_value, round(hi, 4) AS max_value, round(mean, 4) AS mean, round(sd, 4) AS std, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, CAST(outliers AS BIGINT) AS outliers, round(skew, 6) AS skewness, CAST(distinct_n AS BIGINT) AS distinct_n, CASE WHEN sd <= 1e-9D THEN 'constant' WHEN valid < n THEN 'missing values' ELSE 'ready' END AS readiness FROM s CROSS JOIN o"""

STATEMENTS = {"ols_simple": Statement(_OLS_SQL, ("reg",)), "model_comparison_baselines": Statement(_COMPARE, ("reg",))}


def audit(df: DataFrame) -> DataFrame:
    """The statement _AUDIT over df's y, from the distinct values and how often each occurs; they are dealt by ranges, so no task holds all of them."""
    from .banded import instead

    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy("y").agg(F.count("*").alias("times")).repartitionByRange(ranges, "y")
    counts = stored(counts.withColumn("part", F.spark_partition_id()))
    known = counts.filter(F.col("y").isNotNull())
    n = counts.agg(F.sum("times")).first()[0] or 0
    valid, lo, hi, total, distinct = known.agg(F.sum("times"), F.min("y"), F.max("y"), F.sum(F.col("y") * F.col("times")), F.count("*")).first()
    mean = sd = None
    quartiles: list[float | None] = [None] * 3
    if valid:
        mean = total / valid
        sd = math.sqrt(known.agg(F.sum((F.col("y") - mean) ** 2 * F.col("times"))).first()[0] / valid)
        sizes = known.groupBy("part").agg(F.sum("times").alias("k")).orderBy("part").collect()  # a row for each range

        @functools.cache
        def nth(place: int) -> float:
            """the value at a place from 0 in the order of y"""
            for r in sizes:
                if place < r["k"]:
                    upto = F.sum("times").over(Window.partitionBy("part").orderBy("y"))
                    return known.filter(F.col("part") == r["part"]).withColumn("upto", upto).filter(F.col("upto") > place).agg(F.min("y")).first()[0]
                place -= r["k"]
            raise IndexError(place)

        for i, q in enumerate((0.25, 0.5, 0.75)):
            at = q * (valid - 1)
            low, high = math.floor(at), math.ceil(at)
            quartiles[i] = nth(low) if low == high else (high - at) * nth(low) + (at - low) * nth(high)
    row = (n, valid or 0, lo, hi, mean, sd, *quartiles, distinct)
    s = spark.createDataFrame([row], "n long, valid long, lo double, hi double, mean double, sd double, q1 double, q2 double, q3 double, distinct_n long")
    text = instead(_AUDIT, {
        "s": "SELECT * FROM {moments}",
        "o": "SELECT sum(CASE WHEN y < q1 - 1.5D * (q3 - q1) OR y > q3 + 1.5D * (q3 - q1) THEN times ELSE 0 END) AS outliers, sum(times * (y - mean) * (y - mean) * (y - mean)) / nullif(max(valid), 0) / nullif(max(sd * sd * sd), 0D) AS skew FROM {counts} CROSS JOIN s",
    })
    return Statement(text, ("moments", "counts")).run(spark, {"moments": s, "counts": counts})
_X = ["x1", "x2", "x3"]


def _knn(spark, d):
    return stored(neighbours.row_standardised(neighbours.nearest(pts(spark, d), K)))


def _grid(spark, sf_dir: str) -> DataFrame:
    """A count for each feature, for the Poisson family."""
    return reg(spark, sf_dir).withColumn("count", F.floor(F.col("x1") / 10).cast("double"))


QUERIES = {
    "data_readiness_audit": lambda s, d: audit(reg(s, d).select("y")),
    "ols_regression": lambda s, d: ols_terms(reg(s, d), "y", _X).select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 4).alias("std_error")),
    "ols_regression_report": lambda s, d: ols_report(pts(s, d), "v1", ["v2", "v3"], _knn(s, d)),
    "ols_regression_output": lambda s, d: ols_output(pts(s, d), "v1", ["v2", "v3"]),
    "exploratory_regression": lambda s, d: exploratory(reg(s, d), "y", _X),
    "generalized_linear_regression": lambda s, d: glr(reg(s, d), "bin", _X, "logistic"),
    "generalized_linear_regression_output": lambda s, d: glr_output(pts(s, d).withColumn("low", (F.col("cat") < 5).cast("double")), "low", ["v1", "v2", "v3"], "logistic"),
    "generalized_linear_regression_report": lambda s, d: glr_report(_grid(s, d), "count", ["x2", "x3"], "poisson"),
    "quantile_regression": lambda s, d: quantile(reg(s, d), "y", _X),
    "spatial_regime_regression": lambda s, d: regimes(reg(s, d), "y", _X, "regime"),
    "lm_diagnostics": lambda s, d: lm_diagnostics(pts(s, d), _knn(s, d), "v1", ["v2", "v3"]),
    "spatial_durbin_model": lambda s, d: durbin(pts(s, d), _knn(s, d), "v1", ["v2", "v3"]),
    "spatial_autoregression": lambda s, d: spatial_ml(pts(s, d), _knn(s, d), "v1", ["v2", "v3"], "lag"),
    "spatial_error_regression": lambda s, d: spatial_ml(pts(s, d), _knn(s, d), "v1", ["v2", "v3"], "error"),
    "gwr_regression": lambda s, d: gwr(pts(s, d), "v1", ["v2", "v3"]),
    "gwr_report": lambda s, d: gwr_report(gwr(pts(s, d), "v1", ["v2", "v3"])),
    "multiscale_geographically_weighted_regression": lambda s, d: mgwr(pts(s, d), "v1", ["v2", "v3"])[0],
    "esf_regression": lambda s, d: esf(pts(s, d), _knn(s, d), "v1", ["v2", "v3"]),
}

_REG3 = "reg AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) AS x3 FROM lineitem)"
#: The inverse of three predictors' products by cofactors.
ORACLES = {
    "data_readiness_audit": Statement(_AUDIT, ("reg",)).oracle(),
    "ols_regression": f"""WITH {_REG3}, m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM reg),
s AS (SELECT any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(my) AS my,
  sum((x1 - m1) * (x1 - m1)) AS s11, sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (x3 - m3)) AS s13, sum((x2 - m2) * (x2 - m2)) AS s22, sum((x2 - m2) * (x3 - m3)) AS s23, sum((x3 - m3) * (x3 - m3)) AS s33,
  sum((x1 - m1) * (y - my)) AS c1, sum((x2 - m2) * (y - my)) AS c2, sum((x3 - m3) * (y - my)) AS c3, sum((y - my) * (y - my)) AS syy FROM reg, m),
d AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det FROM s),
i AS (SELECT *, (s22 * s33 - s23 * s23) / det AS i11, (s13 * s23 - s12 * s33) / det AS i12, (s12 * s23 - s13 * s22) / det AS i13, (s11 * s33 - s13 * s13) / det AS i22, (s12 * s13 - s11 * s23) / det AS i23, (s11 * s22 - s12 * s12) / det AS i33 FROM d),
b AS (SELECT *, i11 * c1 + i12 * c2 + i13 * c3 AS b1, i12 * c1 + i22 * c2 + i23 * c3 AS b2, i13 * c1 + i23 * c2 + i33 * c3 AS b3 FROM i),
e AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, (syy - b1 * c1 - b2 * c2 - b3 * c3) / (n - 4) AS s2,
  1 / n + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23) AS v0 FROM b)
SELECT 'intercept' AS term, round(b0, 4) AS estimate, round(sqrt(s2 * v0), 4) AS std_error FROM e UNION ALL SELECT 'x1', round(b1, 4), round(sqrt(s2 * i11), 4) FROM e
UNION ALL SELECT 'x2', round(b2, 4), round(sqrt(s2 * i22), 4) FROM e UNION ALL SELECT 'x3', round(b3, 4), round(sqrt(s2 * i33), 4) FROM e""",
}
