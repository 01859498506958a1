"""MinHash near-duplicates (operator 6) with fast similarity sketching (Dahlgaard, Knudsen and Thorup 2017).

A document's set is its distinct k-word shingles. Sketching goes in rounds: in round i < t every element takes
one hashed bin of t, in rounds t to 2t - 1 all elements meet in bin i - t, and each bin keeps the least
(round, value) it sees; rounds end when every bin is filled. So each coordinate fills, in O(t log t + n) expected
time, and the share of equal coordinates has the concentration bounds of t independent MinHashes.

Coordinates are cut into `bands` bands. Documents with equal sets are one class from the start. Within a bucket
(classes that agree on a band) every class is compared with the bucket's smallest one, on full sets; the links'
components are found. Buckets that still hold several components make groups (classes that such buckets connect).
Within a group, classes of different components are compared in tiles of bounded size, first by sketch (a pair goes
on if its estimate is within `sigmas` standard deviations of the threshold), then on full sets; a tile hands on a
spanning forest of the links that it finds, never its pairs. So no bucket is capped, copies never expand into all
pairs, and a group that is one component costs one comparison for each member.

Defined cases: words are runs of anything but ASCII white space, A-Z in lower case; a text with fewer than k words
has the whole sequence as its one shingle; a null text or one without words has an empty set and links with
nothing; a null id links with nothing; repeated rows are copies, and rows with the smallest id of their group are
all kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import materialize, mix64, named, releasing, shingle_sets, small_batches, table, utf8
from ._graph import components


#: Ids up to this number are broadcast (about 8 MB); their texts then needn't be shuffled.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Spec:
    k: int = 5
    percent: int = 80  #: links need 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5
    sigmas: float = 5.0
    tile: int = 400

    @property
    def t(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal coordinates that a pair must have to be compared on full sets within tiles."""
        j = self.percent / 100
        return max(0, math.floor(self.t * j - self.sigmas * math.sqrt(self.t * j * (1 - j))))


def sketches(x: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set; x has the sets' elements one set after the other. Rows of empty sets stay at the maximum."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(counts) * t, top, dtype=np.uint64)
    active = np.flatnonzero(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(active):
                break
            h = mix64(x ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
            np.minimum.at(out, owner * t + bins, (h >> np.uint64(9)) | np.uint64(i << 55))
            unfilled = (out.reshape(-1, t)[active] == top).any(axis=1)
            if not unfilled.all():
                still = np.zeros(len(counts), dtype=bool)
                active = active[unfilled]
                still[active] = True
                keep = still[owner]
                x, owner = x[keep], owner[keep]
    return out.reshape(len(counts), t)


def _band_hashes(sk: np.ndarray, spec: Spec) -> np.ndarray:
    cut = sk.reshape(len(sk), spec.bands, spec.rows)
    h = np.broadcast_to(np.arange(1, spec.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(sk), spec.bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(spec.rows):
            h = mix64(h ^ cut[:, :, r])
    return h.view(np.int64)


def _set_hashes(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's elements; 0 for an empty set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x ^ np.uint64(salt)))])
            stops = np.cumsum(counts)
            out.append((total[stops] - total[stops - counts]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """key, n (set size), h1 and h2 (the set's hash), bands, low (16 bits of each coordinate)."""
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, counts = shingle_sets([utf8(v) for v in b.column(1).to_pylist()], spec.k)
            sk = sketches(x, counts, spec.t)
            bands, low = _band_hashes(sk, spec), (sk >> np.uint64(20)).astype("<u2")
            h1, h2 = _set_hashes(x, counts)
            ends = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * spec.bands)
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1))), pa.array([r.tobytes() for r in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n", "h1", "h2", "bands", "low"])

    return src.mapInArrow(releasing(run), f"key {kind}, n long, h1 long, h2 long, bands array<long>, low binary")


def _full_sets(docs: DataFrame, keys: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """key and s, the full set, for the documents whose key is in keys."""
    wanted = materialize(keys.select("key").distinct())
    if wanted.count() <= BROADCAST_KEYS:  # beyond, the join shuffles the texts
        wanted = F.broadcast(wanted)
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(wanted, "key", "left_semi")
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, counts = shingle_sets([utf8(v) for v in b["text"]], spec.k)
            stops = np.cumsum(counts)
            yield pd.DataFrame({"key": b["key"], "s": [x[q - n : q].tobytes() for n, q in zip(counts, stops, strict=True)]})

    return materialize(src.mapInPandas(releasing(run), f"key {kind}, s binary"))


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if not len(p) or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, spec: Spec) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as u, v."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_similar(x, y, spec.percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    full = _full_sets(docs, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))), key, text, spec)
    joined = pairs.join(full.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b").join(full.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    return joined.filter(similar("sa", "sb")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _within(rows: DataFrame, spec: Spec) -> DataFrame:
    """Links (u, v) that connect all components that are linked within the groups of rows (g, n, key, component, low, s)."""
    kind = rows.schema["key"].dataType.simpleString()
    least, t, percent = spec.least_equal, spec.t, spec.percent
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / spec.tile).cast("int")).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("g", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "key", "component", "low", "s")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "key")

    def compare(group: pd.DataFrame, u: list, v: list) -> None:
        sk = np.frombuffer(b"".join(group["low"]), dtype="<u2").reshape(len(group), t)
        keys, sets, tile = group["key"].tolist(), group["s"].tolist(), group["t"].to_numpy()
        label = pd.factorize(group["component"])[0]
        across = group["i"].iat[0] != group["j"].iat[0]
        for x in range(len(group) - 1):
            ok = label[x + 1 :] != label[x]
            if across:
                ok &= tile[x + 1 :] != tile[x]
            y = x + 1 + np.flatnonzero(ok)
            for z in y[(sk[y] == sk[x]).sum(axis=1) >= least].tolist():
                if label[z] != label[x] and _similar(sets[x], sets[z], percent):
                    u.append(keys[x])
                    v.append(keys[z])
                    label[label == label[z]] = label[x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            of = [batch[c].to_numpy() for c in ("g", "i", "j")]
            starts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in of], axis=0)) + 1).tolist()]
            u: list = []
            v: list = []
            for p, q in zip(starts[:-1], starts[1:], strict=True):
                compare(batch.iloc[p:q], u, v)
            rest = batch.iloc[starts[-1] :]
            yield pd.DataFrame({"u": u, "v": v})
        if rest is not None and len(rest):
            u, v = [], []
            compare(rest, u, v)
            yield pd.DataFrame({"u": u, "v": v})

    return rows.mapInPandas(releasing(run), f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """key, n_shingles, component_id (the smallest id linked, itself included), kept, for each row of docs."""
    small_batches(docs.sparkSession)
    sig = materialize(signatures(docs, key, text, spec))
    full = sig.filter((F.col("n") > 0) & F.col("key").isNotNull())
    classes = materialize(full.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("low").alias("low")))
    rows = classes.select(F.col("rep").alias("key"), F.explode("bands").alias("h"))
    buckets = rows.groupBy("h").agg(F.min("key").alias("c"), F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = materialize(rows.join(buckets, "h").select("h", "n", "c", "key"))
    star = materialize(shared.filter(F.col("key") != F.col("c")).select(F.col("c").alias("a"), F.col("key").alias("b")).distinct())
    links = materialize(_verified(star, docs, key, text, spec))
    comp = components(links)

    placed = shared.filter(F.col("n") > 2).join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter(F.col("x") != F.col("y")).select("h")
    open_ = materialize(placed.join(mixed, "h").select("c", "key", "component"))
    if open_.limit(1).count():
        group = components(open_.select(F.col("key").alias("u"), F.col("c").alias("v"))).select(F.col("node").alias("key"), F.col("component").alias("g"))
        members = group.join(group.groupBy("g").agg(F.count("*").alias("n")), "g").join(open_.select("key", "component").distinct(), "key")
        low = classes.select(F.col("rep").alias("key"), "low").dropDuplicates(["key"])
        found = materialize(_within(members.join(low, "key").join(_full_sets(docs, members, key, text, spec), "key"), spec))
        comp = components(links.unionByName(found))

    of_class = classes.select("h1", "h2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = sig.select("key", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    alone = (F.col("n") == 0) | F.col("key").isNull()
    linked = F.when(alone, F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), linked.alias("component_id"), F.coalesce(F.col("key") == linked, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """The rows of docs that stay: one id of each group; rows without an id stay."""
    gone = near_duplicates(docs, key, text, spec).filter(~F.col("kept")).select(F.col(f"`{key}`").alias("gone")).distinct()
    rows = docs.select(named(docs.columns).alias("row"), F.col(f"`{key}`").alias("key"))
    return rows.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")


#: The registered query links 3-word shingles at 85 percent.
QUERY = Spec(k=3, percent=85)


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), spec=QUERY)


ORACLE = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, both_.b FROM r JOIN both_ ON both_.a = r.y) SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.m AS component_id, d.doc_id = r.m AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id"""

QUERIES = {"op6_minhash": op6_minhash}
ORACLES = {"op6_minhash": ORACLE}
