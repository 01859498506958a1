"""Readiness of fields, quality of regressions, comparison of models, labels of results, and what this engine offers."""

from __future__ import annotations

import importlib.util
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layer import K, clean_numeric, pts, reg
from ..plans import neighbours
from ..plans.gram import gram
from ..plans.store import stored

# Thresholds of the labels, and weights of a model's score.
STRONG_R, HIGH_VIF, HIGH_CONDITION, CONSTANT = 0.85, 7.5, 30.0, 1e-9
W_RMSE, W_MAE, W_COVERAGE, P_PATTERN, P_UNKNOWN = 0.45, 0.25, 0.15, 0.35, 0.25
GI_CLASSES = {-3: "99% cold spot", -2: "95% cold spot", -1: "90% cold spot", 0: "not significant", 1: "90% hot spot", 2: "95% hot spot", 3: "99% hot spot"}
LISA_CLASSES = {"HH": "high-high cluster", "LL": "low-low cluster", "HL": "high-low outlier", "LH": "low-high outlier", "Not Significant": "not significant"}

#: Name tokens that hint at a field's part in an analysis.
ROLES = {"identifier": ("id", "fid", "key", "code"), "weight": ("weight", "pop", "count", "size"), "outcome": ("target", "y", "outcome", "response"), "rate": ("ratio", "rate", "share", "density", "index")}


def role_of(name: str) -> str:
    parts = name.lower().replace("-", "_").split("_")
    return next((role for role, tokens in ROLES.items() if any(p in tokens for p in parts)), "attribute")


def readiness(df: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each field: missing and non-finite values, moments, quartiles, outliers beyond 1.5 quartile ranges, distinct values, role, candidate families and a label.

    One aggregate for all fields, and one more for the outliers.
    """
    raw = {f: F.col(f"`{f}`").try_cast("double") for f in fields}
    c = {f: clean_numeric(F.col(f"`{f}`")) for f in fields}
    aggs: list[Column] = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        odd = F.isnan(raw[f]) | (F.abs(raw[f]) == float("inf"))
        for name, e in (
            ("valid", F.count(c[f])), ("odd", F.count_if(odd)), ("lo", F.min(c[f])), ("hi", F.max(c[f])), ("mean", F.avg(c[f])), ("sd", F.stddev_pop(c[f])), ("skew", F.skewness(c[f])),
            ("q", F.percentile(c[f], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))), ("distinct", F.count_distinct(c[f])), ("neg", F.count_if(c[f] < 0)), ("frac", F.count_if(c[f] != F.floor(c[f]))),
        ):
            aggs.append(e.alias(f"{name}{i}"))
    r = df.agg(*aggs).first()
    fence = [(r[f"q{i}"][0] - 1.5 * (r[f"q{i}"][2] - r[f"q{i}"][0]), r[f"q{i}"][2] + 1.5 * (r[f"q{i}"][2] - r[f"q{i}"][0])) if r[f"q{i}"] else None for i in range(len(fields))]
    out = df.agg(*(F.count_if((c[f] < fence[i][0]) | (c[f] > fence[i][1])).alias(f"o{i}") if fence[i] else F.lit(0).alias(f"o{i}") for i, f in enumerate(fields))).first()
    rows = []
    for i, f in enumerate(fields):
        valid, sd, distinct = r[f"valid{i}"], r[f"sd{i}"], r[f"distinct{i}"]
        label = "empty" if not valid else "constant" if sd <= CONSTANT else "missing values" if valid < r["n"] else "ready"
        binary = valid and distinct == 2 and r[f"lo{i}"] == 0 and r[f"hi{i}"] == 1
        families = [x for x, ok in (("logistic", binary), ("poisson", valid and not r[f"neg{i}"] and not r[f"frac{i}"] and not binary), ("gaussian", valid and distinct > 2)) if ok]
        q = r[f"q{i}"] or [None] * 3
        rows.append((f, role_of(f), r["n"], r["n"] - valid, r[f"odd{i}"], r[f"lo{i}"], r[f"hi{i}"], r[f"mean{i}"], sd, *map(_float, q), int(out[f"o{i}"] or 0), _float(r[f"skew{i}"]), distinct, ",".join(families), label))
    return df.sparkSession.createDataFrame(rows, "field string, role string, n long, missing long, non_finite long, min_value double, max_value double, mean double, std double, q1 double, median double, q3 double, outliers long, skewness double, distinct_n long, families string, readiness string")


def _float(v) -> float | None:
    return None if v is None or v != v else float(v)


def correlations(df: DataFrame, fields: list[str], least: float = 0.0) -> DataFrame:
    """a, b, r, n, strong for all pairs of fields, each over the rows that have both; one aggregate."""
    at = [(i, j) for i in range(len(fields)) for j in range(i + 1, len(fields))]
    c = [clean_numeric(F.col(f"`{f}`")) for f in fields]
    both = {(i, j): c[i].isNotNull() & c[j].isNotNull() for i, j in at}
    row = df.agg(*(F.corr(F.when(both[p], c[p[0]]), F.when(both[p], c[p[1]])).alias(f"r{n}") for n, p in enumerate(at)), *(F.count_if(both[p]).alias(f"n{n}") for n, p in enumerate(at))).first()
    rows = [(fields[i], fields[j], _float(row[f"r{n}"]), row[f"n{n}"]) for n, (i, j) in enumerate(at) if row[f"n{n}"] >= 4]
    rows = [(*x, x[2] is not None and abs(x[2]) >= STRONG_R) for x in rows if x[2] is None or abs(x[2]) >= least]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n long, strong boolean")


def collinearity(df: DataFrame, xs: list[str]) -> DataFrame:
    """field, vif, status and the design's condition number, from one Gram matrix of centred columns."""
    df = df.dropna(subset=xs)
    mean = df.agg(*(F.avg(x).alias(x) for x in xs)).first()
    m = gram(df, [F.lit(1.0), *(F.col(x) - mean[x] for x in xs)])
    cov = m[1:, 1:]
    sd = np.sqrt(np.diag(cov))
    ok = sd > CONSTANT
    r = cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)
    vif = np.full(len(xs), np.nan)
    sub = r[np.ix_(ok, ok)]
    if len(sub):
        vif[ok] = np.where(np.linalg.matrix_rank(sub) < len(sub), np.inf, np.diag(np.linalg.pinv(sub)))
    shift = np.array([mean[x] for x in xs])
    raw = cov + m[0, 0] * np.outer(shift, shift)
    whole = np.block([[np.array([[m[0, 0]]]), (m[0, 0] * shift)[None, :]], [(m[0, 0] * shift)[:, None], raw]])
    ev = np.linalg.eigvalsh(whole)
    cond = float(np.sqrt(ev[-1] / ev[0])) if ev[0] > 0 else float("inf")
    status = ["constant" if not o else "high" if v >= HIGH_VIF else "moderate" if v >= 5 else "low" for o, v in zip(ok, vif, strict=True)]
    return df.sparkSession.createDataFrame([(x, _float(v), s, cond, cond >= HIGH_CONDITION) for x, v, s in zip(xs, vif, status, strict=True)], "field string, vif double, status string, condition_number double, ill_conditioned boolean")


def residual_moran(res: DataFrame, edges: DataFrame) -> dict | None:
    """Moran's I of fid, resid over the edges between the rows that have one; None for fewer than 4 rows or a constant."""
    from .pattern import moran

    res = stored(res.select("fid", F.col("resid").alias("v1")).dropna())
    s = res.agg(F.count("*").alias("n"), F.stddev_pop("v1").alias("sd")).first()
    if s["n"] < 4 or not s["sd"]:
        return None
    row = moran("pts", "v1", "knn").run(res.sparkSession, {"pts": res, "knn": stored(neighbours.restricted(edges, res))}).first()
    return None if row is None or row["moran_i"] is None or row["z_score"] is None else row.asDict()


def pattern_penalty(p_value: float | None) -> float:
    return P_UNKNOWN if p_value is None else P_PATTERN if p_value < 0.05 else 0.0


def scored(rows: list[dict]) -> list[dict]:
    """rows (name, rmse, mae, coverage, p_value: None without a diagnostic) with score and rank, smallest first; `recommended` marks the best of those without a residual pattern, if any."""
    rows = [dict(r) for r in rows]
    top_rmse, top_mae = (max([r[k] for r in rows if r[k] is not None], default=1.0) or 1e-9 for k in ("rmse", "mae"))
    for r in rows:
        part = [1.0 if r[k] is None else r[k] / max(top, 1e-9) for k, top in (("rmse", top_rmse), ("mae", top_mae))]
        r["score"] = W_RMSE * part[0] + W_MAE * part[1] + pattern_penalty(r["p_value"]) + W_COVERAGE * max(0.0, 1.0 - r["coverage"])
    rows.sort(key=lambda r: r["score"])
    clean = [r["name"] for r in rows if r["p_value"] is not None and r["p_value"] >= 0.05]
    for i, r in enumerate(rows, 1):
        r["rank"], r["recommended"] = i, bool(clean) and r["name"] == clean[0]
    return rows


#: Columns by which an output names its model family, the most specific first: family, prediction, residual, whether the row was used.
FAMILIES = (("mgwr", "mgwr_pred", "mgwr_resid", "mgwr_used"), ("sar", "sar_pred", "sar_resid", "sar_used"), ("sem", "sem_pred", "sem_resid", "sem_used"), ("glr", "glr_fit", "glr_resid", "glr_used"), ("gwr", "y_predicted", "residual", None), ("esf", "fitted", "residual", None), ("ols", None, "residual", None))


def family_of(columns: list[str]) -> tuple[str, str | None, str, str | None]:
    for f in FAMILIES:
        if all(c in columns for c in f[1:] if c):
            return f
    raise ValueError("no model output: it has none of the known residual columns")


def compare_models(outputs: dict[str, DataFrame], observed: DataFrame, edges: DataFrame | None) -> DataFrame:
    """A row for each model output (fid and its family's columns) against observed (fid, y): fit, coverage, residual Moran, score and rank."""
    rows, total = [], observed.count()
    for name, df in outputs.items():
        family, pred, resid, used = family_of(df.columns)
        d = (df.filter(F.col(used) != 0) if used else df).join(observed.select("fid", "y"), "fid").dropna(subset=[resid, "y"])
        d = stored(d.select("fid", "y", (F.col(pred) if pred else F.col("y") - F.col(resid)).alias("f"), F.col(resid).alias("resid")))
        e = F.col("y") - F.col("f")
        s = d.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.col("f") - F.col("y")).alias("bias"), F.var_pop("y").alias("v")).first()
        m = residual_moran(d, edges) if edges is not None and s["n"] else None
        rows.append({"name": name, "family": family, "n": s["n"], "coverage": s["n"] / total if total else 0.0, "rmse": math.sqrt(s["mse"]) if s["n"] else None, "mae": s["mae"], "bias": s["bias"], "r2": 1 - s["mse"] / s["v"] if s["v"] else None, "moran_i": m and m["moran_i"], "p_value": m and m["p_value"]})
    out = scored(rows)
    return observed.sparkSession.createDataFrame([tuple(r[k] for k in _COMPARED) for r in out], ", ".join(f"{k} {t}" for k, t in _COMPARED.items()))


_COMPARED = {"name": "string", "family": "string", "n": "long", "coverage": "double", "rmse": "double", "mae": "double", "bias": "double", "r2": "double", "moran_i": "double", "p_value": "double", "score": "double", "rank": "int", "recommended": "boolean"}


def evidence(p: Column) -> Column:
    return F.when(p < 0.01, "very strong").when(p < 0.05, "strong").when(p < 0.10, "suggestive").otherwise("weak")


def neighbour_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: features, least, mean, median and most neighbours, isolated ones, whether all are linked with all, and a label of density."""
    deg = nodes.select("fid").join(edges.groupBy(F.col("src").alias("fid")).agg(F.count("*").alias("m")), "fid", "left").fillna(0, ["m"])
    s = deg.agg(F.count("*").alias("n"), F.min("m").alias("minimum"), F.avg("m").alias("mean"), F.median("m").alias("median"), F.max("m").alias("maximum"), F.count_if(F.col("m") == 0).alias("isolated"))
    label = F.when(F.col("isolated") > 0, "sparse, with isolated features").when(F.col("mean") >= 0.8 * (F.col("n") - 1), "very dense").when(F.col("mean") <= 1, "sparse").otherwise("usable")
    return s.withColumns({"all_connected": (F.col("n") > 1) & (F.col("minimum") == F.col("n") - 1), "density": label})


def moran_reading(result: DataFrame, graph: DataFrame) -> DataFrame:
    """Moran's row (z_score, p_value) with pattern, evidence and what to do next, given the graph's summary."""
    z, sig = F.col("z_score"), F.col("p_value") < 0.05
    todo = F.when(F.col("isolated") > 0, "widen the distance band or use nearest neighbours").when(F.col("all_connected"), "narrow the distance band").when(sig, "locate the pattern with local statistics").otherwise("review scale and distance bands")
    return result.drop("pattern").crossJoin(F.broadcast(graph.select("isolated", "all_connected", "density"))).withColumns({"pattern": F.when(sig & (z > 0), "clustered").when(sig & (z < 0), "dispersed").otherwise("random"), "evidence": evidence(F.col("p_value")), "next_action": todo})  # one row each


def sensitivity_reading(result: DataFrame, graph: DataFrame) -> DataFrame:
    """The sensitivity test's row (p_value) with verdict, cautions and what to do next."""
    sig, dense, alone = F.col("p_value") < 0.05, F.col("density") == "very dense", F.col("isolated") > 0
    cautions = F.concat(F.when(alone, F.array(F.lit("isolated features"))).otherwise(F.array()), F.when(dense, F.array(F.lit("very dense graph"))).otherwise(F.array()), F.when(~sig, F.array(F.lit("try another distance band"))).otherwise(F.array()))
    todo = F.when(alone, "widen the distance band").when(dense, "narrow the distance band").when(sig, "locate the pattern with local statistics").otherwise("review the field, the area and the neighbourhood")
    return result.crossJoin(F.broadcast(graph.select("isolated", "density"))).withColumns({"verdict": F.when(sig, "robust").otherwise("sensitive"), "cautions": cautions, "next_action": todo})  # one row each


def class_summary(df: DataFrame, column: str, kind: str = "gi") -> DataFrame:
    """One row: how many of each kind of class, and the most frequent (ties: the larger name)."""
    c, names = F.col(column), GI_CLASSES if kind == "gi" else LISA_CLASSES
    c = c.cast("int") if kind == "gi" else F.coalesce(F.when(c != "", c), F.lit("Not Significant"))
    n = df.select(c.alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    one, two = (F.col("k") > 0, F.col("k") < 0) if kind == "gi" else (F.col("k").isin("HH", "LL"), F.col("k").isin("HL", "LH"))
    first, second = ("hot", "cold") if kind == "gi" else ("clusters", "outliers")
    label = F.element_at(F.create_map(*(F.lit(v) for kv in ((str(k), v) for k, v in names.items()) for v in kv)), F.col("top"))
    out = n.agg(F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias(first), F.coalesce(F.sum(F.when(two, F.col("n"))), F.lit(0)).alias(second), F.max_by(F.col("k").cast("string"), F.struct("n", F.col("k").cast("string"))).alias("top"))
    return out.select(first, second, (F.col(first) + F.col(second)).alias("significant"), F.coalesce(label, F.col("top"), F.lit("no classified features")).alias("dominant"))


#: Packages that this engine uses, and what for.
PARTS = {"pyspark": "engine", "pyarrow": "transfer to Python", "pandas": "grouped functions", "numpy": "small matrices", "duckdb": "checks of results", "sentencepiece": "tokens of training data"}


def library_status(spark: SparkSession) -> DataFrame:
    from importlib import metadata

    rows = [(p, use, importlib.util.find_spec(p) is not None, metadata.version(p) if importlib.util.find_spec(p) else None) for p, use in PARTS.items()]
    return spark.createDataFrame(rows, "module string, used_for string, available boolean, version string")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers that queries run on: name, rows, columns."""
    from ..layer import INPUTS

    rows = []
    for name in ("pts", "lines", "cells", "reg", "cust"):
        df = INPUTS[name][0](spark, sf_dir)
        rows.append((name, df.count(), ",".join(df.columns)))
    return spark.createDataFrame(rows, "layer string, n long, fields string")


GOALS = ("explore a pattern", "map hot spots or outliers", "choose a distance band", "summarize centre, spread or direction", "build an explanatory model", "compare models", "measure inequality")
GEOMETRIES = ("point", "line", "polygon")
OUTCOMES = ("none", "continuous", "binary", "count")


def advise(goal: int, geometry: int, outcome: int, predictors: bool) -> tuple[str, list[str], list[str]]:
    """(summary, registered operators in order, warnings) for one situation."""
    warnings = []
    if geometry == 1 and goal != 3:
        warnings.append("few operators take lines; use their centres or the linear directional mean")
    if outcome == 0 and goal in (1, 4, 5, 6):
        warnings.append("this goal needs a field to analyse")
    if predictors and goal in (0, 1, 2, 3, 6):
        warnings.append("predictors are for the regressions, not for this goal")
    local = ["getis_ord_gi", "local_moran_lisa"]
    if goal == 2:
        plan = "settle the distance band first", ["calculate_distance_band", "incremental_spatial_autocorrelation", "sensitivity_test"]
    elif goal == 6:
        plan = "measure inequality, then where it concentrates", ["spatial_gini_inequality", "global_moran_knn8", *local]
    elif goal == 3:
        plan = "describe centre and spread", ["linear_directional_mean", "directional_distribution"] if geometry == 1 else ["mean_center", "median_center", "standard_distance", "directional_distribution"]
    elif goal == 4 or predictors:
        first = {2: "generalized_linear_regression (logistic)", 3: "generalized_linear_regression (poisson)"}.get(outcome, "ols_regression")
        plan = "a global model first, then spatial ones", [first, "model_residual_autocorrelation", "gwr_regression", "spatial_autoregression", "model_comparison_matrix"]
    elif goal == 5:
        plan = "compare outputs of two models or more", ["model_comparison_matrix", "model_residual_autocorrelation"]
    elif goal == 1:
        plan = "local statistics", ["calculate_distance_band", *local, "bivariate_spatial_association_lees_l"]
    elif geometry == 0 and outcome == 0:
        plan = "point pattern without a field", ["average_nearest_neighbor", "ripleys_k_function"]
    else:
        plan = "the global pattern, then the local one", ["calculate_distance_band", "global_moran_knn8", "incremental_spatial_autocorrelation", *local]
    return plan[0], ["data_readiness_audit", *plan[1]], warnings


def advisor(spark: SparkSession) -> DataFrame:
    """Advice for every combination of goal, geometry, outcome and whether there are predictors."""
    rows = [(GOALS[g], GEOMETRIES[m], OUTCOMES[o], p, *advise(g, m, o, p)) for g in range(7) for m in range(3) for o in range(4) for p in (False, True)]
    return spark.createDataFrame(rows, "goal string, geometry string, outcome string, predictors boolean, summary string, steps array<string>, warnings array<string>")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import models

    df = pts(spark, sf_dir)
    edges = stored(neighbours.row_standardised(neighbours.nearest(df, K)))
    y = df.select("fid", F.col("v1").alias("y"))
    outputs = {"ols": models.ols_output(df, "v1", ["v2", "v3"]), "gwr": models.gwr(df, "v1", ["v2", "v3"]).select("fid", "y_predicted", "residual"), "glr": models.glr_output(df, "v1", ["v2", "v3"], "gaussian")}
    return compare_models(outputs, y, edges)


def _moran_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pattern import moran

    df = pts(spark, sf_dir)
    edges = stored(neighbours.row_standardised(neighbours.nearest(df, K)))
    return moran_reading(moran("pts", "v1", "knn").run(spark, {"pts": df, "knn": edges}), neighbour_summary(edges, df))


STATEMENTS: dict = {}
QUERIES = {
    "library_status": lambda s, d: library_status(s),
    "sample_dataset_guide": catalog,
    "workflow_advisor": lambda s, d: advisor(s),
    "field_readiness": lambda s, d: readiness(reg(s, d), ["y", "x1", "x2", "x3", "bin"]),
    "field_correlations": lambda s, d: correlations(reg(s, d), ["y", "x1", "x2", "x3"]).select("a", "b", F.round("r", 8).alias("r"), "n", "strong"),
    "collinearity": lambda s, d: collinearity(reg(s, d), ["x1", "x2", "x3"]),
    "model_comparison_matrix": _compared,
    "global_moran_reading": _moran_read,
    "neighbour_summary": lambda s, d: neighbour_summary(neighbours.within(pts(s, d), 0.3), pts(s, d)).select("n", "minimum", F.round("mean", 6).alias("mean"), "median", "maximum", "isolated", "all_connected", "density"),
}
_REG = "reg AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) AS x3 FROM lineitem)"
ORACLES = {
    "field_correlations": f"WITH {_REG} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r, count(*) AS n, abs(corr({a}, {b})) >= 0.85 AS strong FROM reg" for a, b in (("y", "x1"), ("y", "x2"), ("y", "x3"), ("x1", "x2"), ("x1", "x3"), ("x2", "x3"))),
    "neighbour_summary": """WITH p AS (SELECT vec_id AS fid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
d AS (SELECT a.fid, (SELECT count(*) FROM p b WHERE b.fid <> a.fid AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= CAST(0.3 AS DOUBLE) ** 2) AS m FROM p a),
s AS (SELECT count(*) AS n, min(m) AS minimum, avg(m) AS mean, median(m) AS median, max(m) AS maximum, count(*) FILTER (m = 0) AS isolated FROM d)
SELECT n, minimum, round(mean, 6) AS mean, CAST(median AS DOUBLE) AS median, maximum, isolated, n > 1 AND minimum = n - 1 AS all_connected,
  CASE WHEN isolated > 0 THEN 'sparse, with isolated features' WHEN mean >= 0.8 * (n - 1) THEN 'very dense' WHEN mean <= 1 THEN 'sparse' ELSE 'usable' END AS density FROM s""",
}
