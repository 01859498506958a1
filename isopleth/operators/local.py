"""Local statistics: a row for each feature that takes part."""

from __future__ import annotations

from ..functions.dist import two_sided
from ..layer import Statement

_GI = f"""s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(v1) AS m, stddev_pop(v1) AS sd FROM {{pts}}),
nb AS (SELECT src, dst FROM {{knn}} UNION SELECT fid, fid FROM {{pts}}),
l AS (SELECT src AS fid, CAST(count(*) AS DOUBLE) AS c, avg(v1) AS lag FROM nb JOIN {{pts}} p ON p.fid = nb.dst GROUP BY src),
z AS (SELECT fid, c, CASE WHEN sd = 0 OR c >= n THEN 0D ELSE (lag - m) / (sd * sqrt((n / c - 1) / (n - 1))) END AS z FROM l CROSS JOIN s),
p AS (SELECT *, {two_sided('z')} AS p FROM z)
SELECT fid, round(z, 6) AS gi_zscore, round(p, 6) AS gi_pvalue, CAST(CASE WHEN p < 0.01D THEN 3 WHEN p < 0.05D THEN 2 WHEN p < 0.1D THEN 1 ELSE 0 END * sign(z) AS INT) AS gi_conf, CAST(c AS INT) AS gi_nbrs FROM p"""

_LISA = f"""s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(v1) AS m FROM {{pts}}),
z AS (SELECT fid, v1 - m AS z FROM {{pts}} CROSS JOIN s), mo AS (SELECT sum(z * z) / count(*) AS m2, sum(z * z * z * z) / count(*) AS m4 FROM z),
l AS (SELECT e.src AS fid, sum(e.w * z.z) AS lag, sum(e.w) AS w1, sum(e.w * e.w) AS w2, count(*) AS c FROM {{knn}} e JOIN z ON z.fid = e.dst GROUP BY e.src),
i AS (SELECT z.fid, z.z, coalesce(lag, 0D) AS lag, coalesce(c, 0) AS c, z.z / m2 * coalesce(lag, 0D) AS i, -coalesce(w1, 0D) / (n - 1) AS ex,
  coalesce(w2, 0D) * (n - m4 / (m2 * m2)) / (n - 1) + (coalesce(w1, 0D) * coalesce(w1, 0D) - coalesce(w2, 0D)) * (2 * m4 / (m2 * m2) - n) / ((n - 1) * (n - 2)) - coalesce(w1, 0D) * coalesce(w1, 0D) / ((n - 1) * (n - 1)) AS va
  FROM z CROSS JOIN s CROSS JOIN mo LEFT JOIN l ON l.fid = z.fid),
r AS (SELECT *, CASE WHEN va > 0 THEN (i - ex) / sqrt(va) ELSE 0D END AS zs FROM i)
SELECT fid, round(i, 6) AS lisa_i, round(zs, 6) AS lisa_z, round({two_sided('zs')}, 6) AS lisa_p, CASE WHEN {two_sided('zs')} >= 0.05D THEN 'Not Significant' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z > 0 THEN 'HL' WHEN lag > 0 THEN 'LH' ELSE 'LL' END AS quadrant, CAST(c AS INT) AS lisa_nbrs FROM r"""

_LEE = """s AS (SELECT avg(v1) AS mx, stddev_pop(v1) AS dx, avg(v2) AS my, stddev_pop(v2) AS dy FROM {pts}),
l AS (SELECT e.src AS fid, sum(e.w * (p.v2 - my) / dy) / sum(e.w) AS lag, count(*) AS c FROM {knn} e JOIN {pts} p ON p.fid = e.dst CROSS JOIN s GROUP BY e.src)
SELECT p.fid, round((v1 - mx) / dx * coalesce(lag, 0D), 6) AS lee_l, round(coalesce(lag, 0D), 6) AS y_lag_z, CASE WHEN lag IS NULL THEN 'Not Significant' WHEN v1 > mx AND lag > 0 THEN 'High-High' WHEN v1 > mx THEN 'High-Low' WHEN lag > 0 THEN 'Low-High' ELSE 'Low-Low' END AS lee_class, CAST(coalesce(c, 0) AS INT) AS lee_nbrs FROM {pts} p CROSS JOIN s LEFT JOIN l ON l.fid = p.fid"""

_SIM = """s AS (SELECT avg(v1) AS a1, CASE WHEN stddev_pop(v1) = 0 THEN 1D ELSE stddev_pop(v1) END AS d1, avg(v2) AS a2, CASE WHEN stddev_pop(v2) = 0 THEN 1D ELSE stddev_pop(v2) END AS d2, avg(v3) AS a3, CASE WHEN stddev_pop(v3) = 0 THEN 1D ELSE stddev_pop(v3) END AS d3 FROM {pts}),
z AS (SELECT fid, CASE WHEN cat = 3 THEN 1 ELSE 0 END AS t, (v1 - a1) / d1 AS z1, (v2 - a2) / d2 AS z2, (v3 - a3) / d3 AS z3 FROM {pts} CROSS JOIN s),
c AS (SELECT avg(z1) AS c1, avg(z2) AS c2, avg(z3) AS c3 FROM z WHERE t = 1),
d AS (SELECT fid, t, sqrt((z1 - c1) * (z1 - c1) + (z2 - c2) * (z2 - c2) + (z3 - c3) * (z3 - c3)) AS d FROM z CROSS JOIN c),
r AS (SELECT *, CASE WHEN t = 1 THEN 0 ELSE row_number() OVER (PARTITION BY t ORDER BY d, fid) END AS rk, count(*) OVER (PARTITION BY t) AS m FROM d),
q AS (SELECT *, CASE WHEN t = 1 THEN 0D ELSE 100D * (m - rk + 1) / m END AS pct FROM r)
SELECT fid, t AS is_target, round(d, 6) AS sim_index, CAST(rk AS INT) AS sim_rank, round(pct, 6) AS sim_pct, CASE WHEN t = 1 THEN 'Target' WHEN rk <= 10 THEN 'Top 10' WHEN pct >= 75 THEN 'High' WHEN pct >= 50 THEN 'Moderate' ELSE 'Low' END AS sim_tier FROM q"""

# Conditional permutations: for each permutation one hashed order of all features serves every feature; a feature with
# m neighbours takes the first m others in that order.
_COND = """deg AS (SELECT src, count(*) AS m FROM {knn} GROUP BY src), mm AS (SELECT max(m) AS mx FROM deg),
ord AS (SELECT perm, fid, {v} AS v, r FROM (SELECT p.perm, t.fid, t.{v}, row_number() OVER (PARTITION BY p.perm ORDER BY md5(concat('42:', CAST(p.perm AS STRING), ':', CAST(t.fid AS STRING))), t.fid) AS r FROM {t} t CROSS JOIN {perms} p) o CROSS JOIN mm WHERE r <= mx + 1),
own AS (SELECT perm, fid AS src, r AS ro FROM ord),
drawn AS (SELECT d.src, d.m, o.perm, o.v FROM deg d CROSS JOIN ord o LEFT JOIN own w ON w.src = d.src AND w.perm = o.perm WHERE o.fid <> d.src AND o.r <= d.m + CASE WHEN w.ro IS NOT NULL AND w.ro <= d.m THEN 1 ELSE 0 END)"""

_LOCAL_GEARY = "zz AS (SELECT fid, (v1 - (SELECT avg(v1) FROM {pts})) / (SELECT stddev_pop(v1) FROM {pts}) AS z FROM {pts}), " + _COND.replace("{v}", "z").replace("{t}", "zz") + """,
ob AS (SELECT e.src, avg((a.z - b.z) * (a.z - b.z)) AS c, avg(b.z) AS lag, count(*) AS nb, max(a.z) AS z FROM {knn} e JOIN zz a ON a.fid = e.src JOIN zz b ON b.fid = e.dst GROUP BY e.src),
sim AS (SELECT d.src, d.perm, avg((a.z - d.v) * (a.z - d.v)) AS c FROM drawn d JOIN zz a ON a.fid = d.src GROUP BY d.src, d.perm),
st AS (SELECT src, avg(c) AS pm, stddev_pop(c) AS sd, count(*) AS np FROM sim GROUP BY src),
ex AS (SELECT sim.src, sum(CASE WHEN abs(sim.c - pm) >= abs(ob.c - pm) - 1e-12D THEN 1 ELSE 0 END) AS ne FROM sim JOIN st ON st.src = sim.src JOIN ob ON ob.src = sim.src GROUP BY sim.src)
SELECT ob.src AS fid, round(ob.c, 6) AS lgc_c, round((ob.c - pm) / sd, 5) AS lgc_z, round((ne + 1D) / (np + 1D), 6) AS lgc_p, CASE WHEN (ne + 1D) / (np + 1D) >= 0.05D THEN 'Not Significant' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z > 0 THEN 'HL' WHEN lag > 0 THEN 'LH' ELSE 'LL' END AS quadrant, CAST(nb AS INT) AS lgc_nbrs FROM ob JOIN st ON st.src = ob.src JOIN ex ON ex.src = ob.src"""

_BILISA = "zz AS (SELECT fid, (v1 - (SELECT avg(v1) FROM {pts})) / (SELECT stddev_pop(v1) FROM {pts}) AS zx, (v2 - (SELECT avg(v2) FROM {pts})) / (SELECT stddev_pop(v2) FROM {pts}) AS zy FROM {pts}), " + _COND.replace("{v}", "zy").replace("{t}", "zz") + """,
ob AS (SELECT e.src, max(a.zx) AS zx, avg(b.zy) AS lag, max(a.zx) * avg(b.zy) AS i, count(*) AS nb FROM {knn} e JOIN zz a ON a.fid = e.src JOIN zz b ON b.fid = e.dst GROUP BY e.src),
sim AS (SELECT d.src, d.perm, max(a.zx) * avg(d.v) AS i FROM drawn d JOIN zz a ON a.fid = d.src GROUP BY d.src, d.perm),
st AS (SELECT sim.src, avg(sim.i) AS pm, stddev_pop(sim.i) AS sd, count(*) AS np, sum(CASE WHEN abs(sim.i) >= abs(ob.i) - 1e-12D THEN 1 ELSE 0 END) AS ne FROM sim JOIN ob ON ob.src = sim.src GROUP BY sim.src)
SELECT ob.src AS fid, round(i, 6) AS bilisa_i, round((i - pm) / sd, 5) AS bilisa_z, round((ne + 1D) / (np + 1D), 6) AS bilisa_p, CASE WHEN (ne + 1D) / (np + 1D) >= 0.05D THEN 'Not Significant' WHEN zx > 0 AND lag > 0 THEN 'HH' WHEN zx > 0 THEN 'HL' WHEN lag > 0 THEN 'LH' ELSE 'LL' END AS quadrant, CAST(nb AS INT) AS bilisa_nb FROM ob JOIN st ON st.src = ob.src"""

_GWSS = """pr AS (SELECT src, d2, r FROM {nn}), bw AS (SELECT src, max(d2) AS b2 FROM pr GROUP BY src),
w AS (SELECT n.src, p.v1 AS v, (1 - n.d2 / b2) * (1 - n.d2 / b2) AS w FROM {nn} n JOIN bw ON bw.src = n.src JOIN {pts} p ON p.fid = n.dst WHERE n.d2 < b2
  UNION ALL SELECT fid, v1, 1D FROM {pts}),
m AS (SELECT src, sum(w) AS sw, sum(w * w) AS sw2, sum(w * v) / sum(w) AS mu FROM w GROUP BY src),
c AS (SELECT w.src, max(sw) AS sw, max(sw2) AS sw2, max(mu) AS mu, sum(w.w * (v - mu) * (v - mu)) / max(sw) AS va, sum(w.w * (v - mu) * (v - mu) * (v - mu)) / max(sw) AS k3 FROM w JOIN m ON m.src = w.src GROUP BY w.src)
SELECT src AS fid, round(mu, 6) AS gw_mean, round(sqrt(va), 6) AS gw_std, round(CASE WHEN va > 1e-12D THEN k3 / (va * sqrt(va)) ELSE 0D END, 5) AS gw_skew, round(sw * sw / sw2, 6) AS gw_neff FROM c"""

STATEMENTS = {
    "getis_ord_gi": Statement(_GI, ("pts", "knn")),
    "local_moran_lisa": Statement(_LISA, ("pts", "knn")),
    "bivariate_spatial_association_lees_l": Statement(_LEE, ("pts", "knn")),
    "similarity_search": Statement(_SIM, ("pts",)),
    "local_geary_c": Statement(_LOCAL_GEARY.replace("{perms}", "{perms199}"), ("pts", "knn", "perms199")),
    "bivariate_lisa": Statement(_BILISA, ("pts", "knn", "perms")),
    "gw_summary_statistics": Statement(_GWSS, ("pts", "nn")),
}
