"""Global pattern statistics: each is one statement that yields one row (or one for each distance)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dist import two_sided
from ..layer import BAND, INPUTS, Statement, pts
from . import banded, permuted

_Z = "z AS (SELECT fid, v1 - (SELECT avg(v1) FROM {pts}) AS z FROM {pts} WHERE v1 IS NOT NULL)"
#: One way a permuted copy of a value comes about: the k-th in a hashed order takes the value of the k-th by id.
_PERM = """base AS (SELECT fid, {v} AS v, row_number() OVER (ORDER BY fid) AS r FROM {t}),
dealt AS (SELECT p.perm, b.fid, row_number() OVER (PARTITION BY p.perm ORDER BY md5(concat('42:', CAST(p.perm AS STRING), ':', CAST(b.fid AS STRING))), b.fid) AS r FROM base b CROSS JOIN {{perms}} p),
pv AS (SELECT dealt.perm, dealt.fid, base.v FROM dealt JOIN base ON base.r = dealt.r UNION ALL SELECT CAST(0 AS BIGINT), fid, v FROM base)"""


def _perm(value: str, table: str = "{pts}") -> str:
    return _PERM.replace("{v}", value).replace("{t}", table).replace("{{perms}}", "{perms}")


def moran(nodes: str, value: str, edges: str, extra: tuple[str, ...] = ()) -> Statement:
    """Moran's I with the randomization variance; S1 sums over the directed edges present. A constant field, or no edges: I 0, variance 0, z 0, p 1."""
    return Statement(
        f"""val AS (SELECT fid, CAST({value} AS DOUBLE) AS y FROM {{{nodes}}} WHERE {value} IS NOT NULL),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS m FROM val),
z AS (SELECT fid, y - m AS z FROM val CROSS JOIN s),
mo AS (SELECT sum(z * z) AS s2, sum(z * z * z * z) AS s4 FROM z),
e AS (SELECT {{{edges}}}.src, {{{edges}}}.dst, {{{edges}}}.w, a.z AS zi, b.z AS zj FROM {{{edges}}} JOIN z a ON a.fid = {{{edges}}}.src JOIN z b ON b.fid = {{{edges}}}.dst),
num AS (SELECT sum(w * zi * zj) AS num, sum(w) AS s0 FROM e),
q1 AS (SELECT 0.5D * sum((a.w + coalesce(b.w, 0D)) * (a.w + coalesce(b.w, 0D))) AS s1 FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src),
q2 AS (SELECT sum(t * t) AS s2w FROM (SELECT id, sum(w) AS t FROM (SELECT src AS id, w FROM e UNION ALL SELECT dst, w FROM e) u GROUP BY id) g),
c AS (SELECT n, num, nullif(s0, 0D) AS s0, s1, s2w, nullif(s2, 0D) AS s2, (s4 / nullif(n, 0D)) / nullif((s2 / nullif(n, 0D)) * (s2 / nullif(n, 0D)), 0D) AS k, -1D / nullif(n - 1, 0D) AS ex FROM s CROSS JOIN mo CROSS JOIN num CROSS JOIN q1 CROSS JOIN q2),
va AS (SELECT *, n / s0 * num / s2 AS i, (n * ((n * n - 3 * n + 3) * s1 - n * s2w + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2w + 6 * s0 * s0)) / nullif((n - 1) * (n - 2) * (n - 3) * s0 * s0, 0D) - ex * ex AS var FROM c),
r AS (SELECT n, ex, coalesce(i, 0D) AS i, coalesce(var, 0D) AS var, CASE WHEN var > 0 THEN (i - ex) / sqrt(var) ELSE 0D END AS zs FROM va)
SELECT CAST(n AS BIGINT) AS n, round(i, 8) AS moran_i, round(ex, 8) AS expected, round(var, 10) AS variance, round(zs, 6) AS z_score, round({two_sided('zs')}, 8) AS p_value,
  CASE WHEN {two_sided('zs')} >= 0.05D THEN 'random' WHEN zs > 0 THEN 'clustered' ELSE 'dispersed' END AS pattern FROM r""",
        (nodes, edges, *extra),
    )


_PSUM = """st AS (SELECT stat AS obs FROM ps WHERE perm = 0), pm AS (SELECT avg(stat) AS pm, stddev_pop(stat) AS sd, count(*) AS np FROM ps WHERE perm > 0),
ext AS (SELECT count(*) AS ne FROM ps CROSS JOIN st CROSS JOIN pm WHERE perm > 0 AND abs(stat - pm) >= abs(obs - pm) - 1e-12D)
SELECT round(obs, 8) AS statistic, round(pm, 8) AS perm_mean, round(sd, 8) AS perm_std, round((obs - pm) / sd, 5) AS z_score, round((ne + 1D) / (np + 1D), 6) AS p_value FROM st CROSS JOIN pm CROSS JOIN ext"""

_GEARY = _perm("v1") + """, m AS (SELECT avg(v) AS m, sum(v * v) - count(*) * avg(v) * avg(v) AS ss, count(*) AS n FROM base),
num AS (SELECT a.perm, sum(e.w * (a.v - b.v) * (a.v - b.v)) AS num, sum(e.w) AS s0 FROM {knn} e JOIN pv a ON a.fid = e.src JOIN pv b ON b.fid = e.dst AND b.perm = a.perm GROUP BY a.perm),
ps AS (SELECT perm, (n - 1) * num / (2 * s0 * ss) AS stat FROM num CROSS JOIN m), """ + _PSUM

_LEE = _perm("v2") + """, sx AS (SELECT avg(v1) AS mx, stddev_pop(v1) AS dx, avg(v2) AS my, stddev_pop(v2) AS dy FROM {pts}),
zx AS (SELECT fid, (v1 - mx) / dx AS zx FROM {pts} CROSS JOIN sx),
lag AS (SELECT p.perm, e.src, sum(e.w * (p.v - my) / dy) / sum(e.w) AS ly FROM {knn} e JOIN pv p ON p.fid = e.dst CROSS JOIN sx GROUP BY p.perm, e.src),
ps AS (SELECT perm, avg(zx * coalesce(ly, 0D)) AS stat FROM zx LEFT JOIN lag ON lag.src = zx.fid GROUP BY perm), """ + _PSUM

_JOIN = """med AS (SELECT v AS med FROM (SELECT v1 AS v, row_number() OVER (ORDER BY v1, fid) AS r, count(*) OVER () AS n FROM {pts}) o WHERE r = floor(n / 2) + 1),
bin AS (SELECT fid, CASE WHEN v1 > med THEN 1 ELSE 0 END AS b FROM {pts} CROSS JOIN med), """ + _perm("b", "bin") + """,
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {knn}),
cnt AS (SELECT x.perm, CAST(sum(x.v * y.v) AS DOUBLE) AS bb, CAST(sum((1 - x.v) * (1 - y.v)) AS DOUBLE) AS ww, CAST(sum(abs(x.v - y.v)) AS DOUBLE) AS bw FROM pairs p JOIN pv x ON x.fid = p.a JOIN pv y ON y.fid = p.b AND y.perm = x.perm GROUP BY x.perm),
lg AS (SELECT perm, 'BB' AS kind, bb AS stat FROM cnt UNION ALL SELECT perm, 'WW', ww FROM cnt UNION ALL SELECT perm, 'BW', bw FROM cnt),
o AS (SELECT kind, stat AS obs FROM lg WHERE perm = 0), m AS (SELECT kind, avg(stat) AS pm, stddev_pop(stat) AS sd, count(*) AS np FROM lg WHERE perm > 0 GROUP BY kind),
x AS (SELECT lg.kind, sum(CASE WHEN abs(stat - pm) >= abs(obs - pm) - 1e-9D THEN 1 ELSE 0 END) AS ne FROM lg JOIN o ON o.kind = lg.kind JOIN m ON m.kind = lg.kind WHERE perm > 0 GROUP BY lg.kind)
SELECT o.kind, CAST(obs AS BIGINT) AS observed, round(pm, 6) AS perm_mean, round(sd, 6) AS perm_std, round((obs - pm) / sd, 5) AS z_score, round((ne + 1D) / (np + 1D), 6) AS p_value FROM o JOIN m ON m.kind = o.kind JOIN x ON x.kind = o.kind"""

_GINI = """y AS (SELECT fid, v1 - (SELECT min(v1) FROM {pts}) AS v1 FROM {pts}), """ + _perm("v1", "y") + """,
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(v) AS m FROM base),
ranked AS (SELECT v, row_number() OVER (ORDER BY v, fid) AS r FROM base),
tot AS (SELECT sum((2D * r - n - 1) * v) AS total FROM ranked CROSS JOIN s),
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {knn}),
nb AS (SELECT x.perm, sum(abs(x.v - z.v)) AS near, CAST(count(*) AS DOUBLE) AS np FROM pairs p JOIN pv x ON x.fid = p.a JOIN pv z ON z.fid = p.b AND z.perm = x.perm GROUP BY x.perm),
g AS (SELECT perm, np, near / (n * n * m) AS gn, (total - near) / (n * n * m) AS go, total / (n * n * m) AS gini, ((total - near) / (n * (n - 1) / 2 - np)) / (near / np) AS pol FROM nb CROSS JOIN tot CROSS JOIN s),
ob AS (SELECT * FROM g WHERE perm = 0), c AS (SELECT sum(CASE WHEN g.go / g.gini >= ob.go / ob.gini - 1e-12D THEN 1 ELSE 0 END) AS hi, sum(CASE WHEN g.go / g.gini <= ob.go / ob.gini + 1e-12D THEN 1 ELSE 0 END) AS lo, count(*) AS np FROM g CROSS JOIN ob WHERE g.perm > 0)
SELECT round(ob.gini, 8) AS gini, round(gn, 8) AS neighbour_part, round(go, 8) AS other_part, round(go / gini, 8) AS spatial_gini, round(pol, 6) AS polarization, round((hi + 1D) / (c.np + 1D), 6) AS p_value, round((lo + 1D) / (c.np + 1D), 6) AS p_low FROM ob CROSS JOIN c"""

_GENERAL_G = f"""x AS (SELECT fid, v1 - (SELECT min(v1) FROM {{pts}}) AS x FROM {{pts}}),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS m1, sum(x * x) AS m2, sum(x * x * x) AS m3, sum(x * x * x * x) AS m4 FROM x),
w AS (SELECT sum(a.x * b.x) AS num, CAST(count(*) AS DOUBLE) AS s0 FROM {{band}} e JOIN x a ON a.fid = e.src JOIN x b ON b.fid = e.dst),
deg AS (SELECT sum(d * d) AS sd2 FROM (SELECT src, CAST(count(*) AS DOUBLE) AS d FROM {{band}} GROUP BY src) q),
c AS (SELECT n, m1, m2, m3, m4, num / (m1 * m1 - m2) AS g, s0 / (n * (n - 1)) AS eg, s0, 2 * s0 AS s1, 4 * sd2 AS s2 FROM s CROSS JOIN w CROSS JOIN deg),
b AS (SELECT *, (n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0 AS b0, -((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0) AS b1, -(2 * n * s1 - (n + 3) * s2 + 6 * s0 * s0) AS b2, 4 * (n - 1) * s1 - 2 * (n + 1) * s2 + 8 * s0 * s0 AS b3, s1 - s2 + s0 * s0 AS b4 FROM c),
v AS (SELECT *, (b0 * m2 * m2 + b1 * m4 + b2 * m1 * m1 * m2 + b3 * m1 * m3 + b4 * m1 * m1 * m1 * m1) / ((m1 * m1 - m2) * (m1 * m1 - m2) * n * (n - 1) * (n - 2) * (n - 3)) - eg * eg AS var FROM b),
r AS (SELECT *, (g - eg) / sqrt(var) AS z FROM v)
SELECT round(g, 8) AS general_g, round(eg, 8) AS expected, round(var, 12) AS variance, round(z, 4) AS z_score, round({two_sided('z')}, 6) AS p_value FROM r"""

_INCREMENTAL = f"""z AS (SELECT fid, v1 - (SELECT avg(v1) FROM {{pts}}) AS z FROM {{pts}}),
mo AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z * z) AS s2, sum(z * z * z * z) AS s4 FROM z),
pe AS (SELECT b.d, e.src, a.z AS zi, c.z AS zj FROM {{band}} e CROSS JOIN {{bands}} b JOIN z a ON a.fid = e.src JOIN z c ON c.fid = e.dst WHERE e.d2 <= b.d * b.d),
dg AS (SELECT b.d, z.fid, coalesce(g.m, 0) AS m FROM z CROSS JOIN {{bands}} b LEFT JOIN (SELECT d, src, count(*) AS m FROM pe GROUP BY d, src) g ON g.d = b.d AND g.src = z.fid),
nb AS (SELECT d, min(m) AS lo, max(m) AS hi, percentile_cont(0.5) WITHIN GROUP (ORDER BY m) AS med, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS iso, sum(CAST(m AS DOUBLE) * m) AS m2 FROM dg GROUP BY d),
st AS (SELECT d, sum(zi * zj) AS num, CAST(count(*) AS DOUBLE) AS s0 FROM pe GROUP BY d),
c AS (SELECT st.d, n, n / s0 * num / s2 AS i, -1D / (n - 1) AS ex, s0, 2 * s0 AS s1, 4 * m2 AS s2w, (s4 / n) / ((s2 / n) * (s2 / n)) AS k, lo, hi, med, iso FROM st JOIN nb ON nb.d = st.d CROSS JOIN mo),
va AS (SELECT *, (n * ((n * n - 3 * n + 3) * s1 - n * s2w + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2w + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ex * ex AS var FROM c),
r AS (SELECT *, (i - ex) / sqrt(var) AS z FROM va)
SELECT round(d, 6) AS distance, round(i, 8) AS moran_i, round(z, 6) AS z_score, round({two_sided('z')}, 6) AS p_value, CAST(lo AS BIGINT) AS min_nbrs, CAST(hi AS BIGINT) AS max_nbrs, round(CAST(med AS DOUBLE), 4) AS median_nbrs, CAST(iso AS BIGINT) AS isolated, abs(z) = max(abs(z)) OVER () AS is_peak FROM r"""

_RIPLEY = """b AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-12D) AS area FROM {pts}),
c AS (SELECT d, count(src) AS pairs FROM {bands} LEFT JOIN {band} ON d2 <= d * d GROUP BY d)
SELECT round(d, 6) AS distance, CAST(pairs AS BIGINT) AS pairs, round(area * pairs / (n * (n - 1)), 8) AS k, round(3.141592653589793D * d * d, 8) AS expected_k, round(sqrt(area * pairs / (n * (n - 1)) / 3.141592653589793D), 8) AS l, round(sqrt(area * pairs / (n * (n - 1)) / 3.141592653589793D) - d, 8) AS l_minus_d FROM c CROSS JOIN b"""

_ANN = f"""b AS (SELECT CAST(count(*) AS DOUBLE) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS a0 FROM {{pts}}),
a AS (SELECT n, CASE WHEN a0 > 0 THEN a0 ELSE 1D END AS area FROM b), o AS (SELECT avg(sqrt(d2)) AS obs FROM {{nn}} WHERE r = 1),
c AS (SELECT n, obs, 0.5D / sqrt(n / area) AS ex, 0.26136D / sqrt(n * n / area) AS se FROM a CROSS JOIN o)
SELECT round(obs, 8) AS observed, round(ex, 8) AS expected, round(obs / ex, 8) AS ratio, round((obs - ex) / se, 6) AS z_score, round({two_sided('(obs - ex) / se')}, 8) AS p_value FROM c"""

_BAND_STATS = """k AS (SELECT src, sqrt(max(d2)) AS d FROM {nn} GROUP BY src)
SELECT round(min(d), 8) AS min_distance, round(max(d), 8) AS max_distance, round(avg(d), 8) AS mean_distance, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY d), 8) AS median_distance, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY d), 8) AS p25, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY d), 8) AS p75 FROM k"""

_Q = _perm("cat") + """, v AS (SELECT fid, v1 FROM {pts}), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, var_pop(v1) AS va FROM v),
g AS (SELECT perm, pv.v AS h, CAST(count(*) AS DOUBLE) AS nh, var_pop(v1) AS vh FROM pv JOIN v ON v.fid = pv.fid GROUP BY perm, pv.v),
ps AS (SELECT perm, 1 - sum(nh * vh) / max(n * va) AS q FROM g CROSS JOIN t GROUP BY perm),
ob AS (SELECT q AS obs FROM ps WHERE perm = 0)
SELECT round(max(obs), 8) AS q, round((sum(CASE WHEN q >= obs - 1e-12D THEN 1 ELSE 0 END) + 1D) / (count(*) + 1D), 6) AS p_value, (SELECT count(DISTINCT cat) FROM {pts}) AS strata FROM ps CROSS JOIN ob WHERE perm > 0"""

_CLQ = _perm("cat") + """, nb AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM base), cb AS (SELECT CAST(sum(CASE WHEN v = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS nb FROM base),
loc AS (SELECT a.perm, e.src, avg(CASE WHEN b.v = 1 THEN 1D ELSE 0D END) AS sh FROM {knn} e JOIN pv a ON a.fid = e.src AND a.v = 0 JOIN pv b ON b.fid = e.dst AND b.perm = a.perm GROUP BY a.perm, e.src),
ps AS (SELECT perm, avg(sh) / max(nb / (n - 1)) AS stat FROM loc CROSS JOIN nb CROSS JOIN cb GROUP BY perm), """ + _PSUM

_SENS = _perm("v1") + """, m AS (SELECT avg(v) AS m, var_pop(v) AS s2 FROM base),
ps AS (SELECT a.perm, sum((a.v - m) * (b.v - m)) / (count(*) * max(s2)) AS stat FROM {band} e JOIN pv a ON a.fid = e.src JOIN pv b ON b.fid = e.dst AND b.perm = a.perm CROSS JOIN m GROUP BY a.perm),
ob AS (SELECT stat AS obs FROM ps WHERE perm = 0)
SELECT round(max(obs), 8) AS observed, round(avg(stat), 8) AS sim_mean, round(stddev_pop(stat), 8) AS sim_std, round(percentile_cont(0.05) WITHIN GROUP (ORDER BY stat), 8) AS p05, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY stat), 8) AS p95, round((sum(CASE WHEN abs(stat) >= abs(obs) - 1e-12D THEN 1 ELSE 0 END) + 1D) / (count(*) + 1D), 6) AS p_value FROM ps CROSS JOIN ob WHERE perm > 0"""

def _with(make):
    """A query over the points layer and one of its graphs."""

    def run(spark, sf_dir: str):
        return make(pts(spark, sf_dir), lambda graph: INPUTS[graph][0](spark, sf_dir))

    return run


def _from_zero(df):
    low = df.agg(F.min("v1")).first()[0]
    return df.withColumn("v1", F.col("v1") - low)


STATEMENTS = {
    "global_moran_knn8": moran("pts", "v1", "knn"),
    "global_moran_queen": moran("cells", "value", "queen"),
    "global_moran_rook": moran("cells", "value", "rook"),
    "average_nearest_neighbor": Statement(_ANN, ("pts", "nn")),
    "calculate_distance_band": Statement(_BAND_STATS, ("nn",)),
    "geodetector_q_statistic": Statement(_Q, ("pts", "perms")),
}
#: Statistics with sums over edges under permutations, or over all pairs in a distance: the query doesn't list them, the statement is what other engines run.
_PLAIN = {
    "general_g_autocorrelation": Statement(_GENERAL_G, ("pts", "band")),
    "incremental_spatial_autocorrelation": Statement(_INCREMENTAL, ("pts", "band", "bands")),
    "ripleys_k_function": Statement(_RIPLEY, ("pts", "band", "bands")),
    "geary_c_autocorrelation": Statement(_GEARY, ("pts", "knn", "perms")),
    "global_bivariate_lee_l": Statement(_LEE, ("pts", "knn", "perms")),
    "join_count_statistics": Statement(_JOIN, ("pts", "knn", "perms")),
    "spatial_gini_inequality": Statement(_GINI.replace("{perms}", "{perms99}"), ("pts", "knn", "perms99")),
    "colocation_quotient": Statement(_CLQ, ("pts", "knn", "perms")),
    "sensitivity_test": Statement(_SENS, ("pts", "band", "perms")),
}
#: Those of INPUTS["bands"].
_BANDS = [i * 0.03 for i in range(1, 11)]
QUERIES = {
    "general_g_autocorrelation": lambda s, d: banded.general_g(_GENERAL_G, pts(s, d), BAND),
    "incremental_spatial_autocorrelation": lambda s, d: banded.incremental(_INCREMENTAL, pts(s, d), _BANDS),
    "ripleys_k_function": lambda s, d: banded.ripley(_RIPLEY, pts(s, d), _BANDS),
    "geary_c_autocorrelation": _with(lambda p, g: permuted.geary_c(p, g("knn"), "v1")),
    "global_bivariate_lee_l": _with(lambda p, g: permuted.global_lee_l(p, g("knn"), "v1", "v2")),
    "join_count_statistics": _with(lambda p, g: permuted.join_counts(p, g("knn"), "v1")),
    "spatial_gini_inequality": _with(lambda p, g: permuted.spatial_gini(_from_zero(p), g("knn"), "v1")),
    "colocation_quotient": _with(lambda p, g: permuted.colocation(p, g("knn"), "cat", 0, 1)),
    "sensitivity_test": lambda s, d: banded.sensitivity(pts(s, d), BAND),
}
ORACLES = {k: s.oracle() for k, s in _PLAIN.items()}
