"""Regions and clusters from minimum spanning trees: SKATER and HDBSCAN.

Edges are made and weighed on the cluster, and the tree is found there, by Boruvka's rounds: each component takes its
least edge, and labels meet. What the driver then cuts is the tree: one edge for each feature, up to MOST.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import neighbours
from ..plans.store import stored

#: Features of a tree that the driver cuts.
MOST = 2_000_000


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (a, b, cost) of a minimum spanning forest of undirected edges (a, b, cost); ties go by the ids."""
    key = F.struct("cost", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cost").groupBy("a", "b").agg(F.min("cost").alias("cost")).withColumn("k", key))
    label = stored(nodes.select(F.col("fid").alias("v"), F.col("fid").alias("c")))
    out: list[DataFrame] = []
    while True:
        live = edges.join(label.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").filter("ca <> cb")
        least = stored(live.select("ca", "cb", "k").unionByName(live.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "k")).groupBy("ca").agg(F.min(F.struct("k", "cb")).alias("m")).select(F.col("ca").alias("c"), F.col("m.cb").alias("to"), F.col("m.k").alias("k")))
        if not least.limit(1).count():
            break
        out.append(least.select(F.col("k.lo").alias("a"), F.col("k.hi").alias("b"), F.col("k.cost").alias("cost")).distinct())
        # each component points at another; two that point at each other meet in the smaller, and pointers are doubled
        back = least.select(F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        up = least.join(back, ["c", "to"], "left").select("c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:
            up = stored(up)
            nxt = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.c"), "left").select(F.col("x.c").alias("c"), F.coalesce("y.to", "x.to").alias("to"), (F.coalesce("y.to", "x.to") != F.col("x.to")).alias("moved"))
            nxt = stored(nxt)
            if not nxt.filter("moved").limit(1).count():
                break
            up = nxt.select("c", "to")
        label = stored(label.join(up, "c", "left").select("v", F.coalesce("to", "c").alias("c")))
    if not out:
        return nodes.sparkSession.createDataFrame([], edges.select("a", "b", "cost").schema)
    forest = out[0]
    for more in out[1:]:
        forest = forest.unionByName(more)
    return forest


def _tree(nodes: DataFrame, forest: DataFrame, cols: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    got = nodes.select("fid", *cols).limit(most + 1).toArrow().sort_by("fid")
    if got.num_rows > most:
        raise ValueError(f"the tree takes up to {most} features")
    fid = got["fid"].to_numpy()
    e = forest.toArrow()  # one edge for each feature at most
    a, b = (np.searchsorted(fid, e[c].to_numpy()) for c in ("a", "b"))
    return fid, np.column_stack([got[c].to_numpy() for c in cols]) if cols else np.zeros((len(fid), 0)), a, b, e["cost"].to_numpy()


def skater(df: DataFrame, edges: DataFrame, fields: list[str], k: int = 3, most: int = MOST) -> DataFrame:
    """fid, region_id (1 to k, by size), region_size, region_ssd: the spanning tree of the edges (src, dst), cut k - 1 times where the sum of squares falls most (Assuncao et al. 2006)."""
    from .learning import _standard
    from .models import complete

    ready = _standard(complete(df, fields), fields)
    z = stored(ready.select("fid", *(F.col(f"z_{f}").alias(f"z{i}") for i, f in enumerate(fields))))
    names = [f"z{i}" for i in range(len(fields))]
    left, right = z.select(F.col("fid").alias("a"), *(F.col(c).alias(f"a_{c}") for c in names)), z.select(F.col("fid").alias("b"), *(F.col(c).alias(f"b_{c}") for c in names))
    cost = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in names), F.lit(0.0))
    costed = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().join(left, "a").join(right, "b").select("a", "b", cost.alias("cost"))
    fid, v, a, b, _ = _tree(z, spanning_forest(z, costed), names, most)
    n = len(fid)
    if len(a) != n - 1:
        raise ValueError("the neighbourhood graph is not connected")
    if not 1 <= k <= n:
        raise ValueError("k must be from 1 to the number of features")
    links: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        links[x].append(y)
        links[y].append(x)
    square = (v * v).sum(axis=1)

    def ssd(count: float, s: np.ndarray, q: float) -> float:
        return float(q - s @ s / count) if count else 0.0

    def best(root: int) -> tuple[float, int, int, list[int]]:
        """(gain, child, parent, members) of the best cut in the tree that holds root; sums of subtrees in one walk."""
        order, parent = [root], {root: -1}
        for x in order:
            for y in links[x]:
                if y not in parent:
                    parent[y] = x
                    order.append(y)
        at = {x: i for i, x in enumerate(order)}
        count, sums, sq = np.ones(len(order)), v[order].copy(), square[order].copy()
        for i in range(len(order) - 1, 0, -1):
            up = at[parent[order[i]]]
            count[up] += count[i]
            sums[up] += sums[i]
            sq[up] += sq[i]
        whole = ssd(count[0], sums[0], sq[0])
        if len(order) < 2:
            return -1.0, -1, -1, order
        rest = count[0] - count[1:]
        inner = (sq[1:] - (sums[1:] ** 2).sum(axis=1) / count[1:]) + ((sq[0] - sq[1:]) - ((sums[0] - sums[1:]) ** 2).sum(axis=1) / rest)
        i = int(np.argmin(inner)) + 1
        return whole - float(inner[i - 1]), order[i], parent[order[i]], order

    regions = [best(0)]
    while len(regions) < k:
        i = max(range(len(regions)), key=lambda j: regions[j][0])
        gain, child, parent, _ = regions[i]
        if child < 0:
            break
        links[child].remove(parent)
        links[parent].remove(child)
        regions[i : i + 1] = [best(parent), best(child)]
    rows = []
    for label, (*_, members) in enumerate(sorted(regions, key=lambda r: (-len(r[3]), min(r[3]))), 1):
        s = ssd(len(members), v[members].sum(axis=0), float(square[members].sum()))
        rows += [(int(fid[m]), label, len(members), max(0.0, s)) for m in members]
    out = df.sparkSession.createDataFrame(rows, "fid long, region_id int, region_size int, region_ssd double")
    return df.select("fid").join(out, "fid", "left")


#: Features up to which the tree of mutual reachability is that of all pairs.
EXACT = 20_000


def _all_pairs_tree(v: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree over mutual reachability, a row of distances at a time."""
    n = len(v)
    core = np.empty(n)
    for i in range(n):
        core[i] = np.partition(((v - v[i]) ** 2).sum(axis=1), min(n, least) - 1)[min(n, least) - 1]
    best, source, free = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    a, b, cost, at = [], [], [], 0
    for _ in range(n - 1):
        free[at] = False
        reach = np.maximum(np.maximum(((v - v[at]) ** 2).sum(axis=1), core[at]), core)
        closer = free & (reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(np.where(free, best, np.inf).argmin())
        a.append(source[at])
        b.append(at)
        cost.append(math.sqrt(best[at]))
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(cost)


def hdbscan(df: DataFrame, fields: list[str], least: int = 5, most: int = MOST, exact: int = EXACT) -> DataFrame:
    """fid, cluster_id (-1: noise), cluster_prob: density clusters of standardised fields (Campello, Moulavi and Sander 2013).

    Up to `exact` features the tree is that of all pairs. Beyond, for two fields, its edges go to 4 * least nearest places, and
    to more until the graph is connected; links longer than those lists reach may then differ from the exact ones.
    """
    from .learning import _standard
    from .models import complete

    z = stored(_standard(complete(df, fields), fields).select("fid", *(F.col(f"z_{f}").alias(f"z{i}") for i, f in enumerate(fields))))
    names, n = [f"z{i}" for i in range(len(fields))], z.count()
    if n < 2 * least:
        return df.select("fid").join(z.select("fid", F.lit(-1).alias("cluster_id"), F.lit(0.0).alias("cluster_prob")), "fid", "left")
    if n <= exact:
        got = z.toArrow().sort_by("fid")  # at most `exact` features
        fid = got["fid"].to_numpy()
        a, b, cost = _all_pairs_tree(np.column_stack([got[c].to_numpy() for c in names]), least)
    else:
        if len(fields) != 2:
            raise ValueError(f"more than {exact} features: two fields")
        xy, k = z.select("fid", F.col("z0").alias("x"), F.col("z1").alias("y")), 4 * least
        while True:
            near = stored(neighbours.nearest(xy, k))
            core = near.filter(F.col("r") <= max(1, least - 1)).groupBy("src").agg(F.max("d2").alias("core"))
            costed = near.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("other")), "dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.sqrt(F.greatest("d2", "core", "other")).alias("cost"))
            fid, _, a, b, cost = _tree(xy, spanning_forest(xy, costed), [], most)
            if len(a) == n - 1 or k >= n - 1:
                break
            k = min(n - 1, 4 * k)
    label, prob = condensed(n, a, b, cost, least)
    out = df.sparkSession.createDataFrame([(int(f), int(c), float(p)) for f, c, p in zip(fid, label, prob, strict=True)], "fid long, cluster_id int, cluster_prob double")
    return df.select("fid").join(out, "fid", "left")


def condensed(n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and membership strengths from the edges of a spanning tree: the clusters of greatest stability."""
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    left, right, height, top = [-1] * (2 * n - 1), [-1] * (2 * n - 1), [0.0] * (2 * n - 1), n

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.lexsort((b, a, cost)).tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        left[top], right[top], height[top], size[top] = x, y, float(cost[i]), size[x] + size[y]
        parent[x] = parent[y] = top
        top += 1
    root = top - 1
    birth, stability, kids, member = {0: 0.0}, defaultdict(float), defaultdict(list), {}
    leave = np.zeros(n)
    todo, made = [(root, 0)], 1

    def density(h: float) -> float:
        return 1 / h if h > 0 else math.inf

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [left[x], right[x]]
        return out

    top_density = density(min((h for h in height[n:top] if h > 0), default=1.0))
    while todo:
        node, c = todo.pop()
        if node < n:
            member[node], leave[node] = c, top_density
            continue
        lam = min(density(height[node]), top_density)
        big = [x for x in (left[node], right[node]) if size[x] >= least]
        if len(big) == 2:
            stability[c] += (lam - birth[c]) * size[node]
            for x in big:
                birth[made] = lam
                kids[c].append(made)
                todo.append((x, made))
                made += 1
            continue
        for x in (left[node], right[node]):
            if x in big:
                todo.append((x, c))
            else:
                for q in points(x):
                    member[q], leave[q] = c, lam
                    stability[c] += lam - birth[c]
    chosen: set[int] = set()
    value = dict(stability)
    for c in range(made - 1, 0, -1):
        inner = sum(value.get(k, 0.0) for k in kids[c])
        if kids[c] and inner > value.get(c, 0.0):
            value[c] = inner
        else:
            chosen.add(c)
    final: dict[int, int] = {}
    stack = [(c, -1) for c in kids[0]]
    while stack:
        c, own = stack.pop()
        own = own if own >= 0 else c if c in chosen else -1
        final[c] = own
        stack += [(k, own) for k in kids[c]]
    names = {c: i for i, c in enumerate(sorted({v for v in final.values() if v >= 0}))}
    label = np.array([names.get(final.get(member[i], -1), -1) for i in range(n)])
    prob = np.zeros(n)
    for c in range(len(names)):
        own = label == c
        most = leave[own].max()
        prob[own] = leave[own] / most if most > 0 else 1.0
    return label, prob
