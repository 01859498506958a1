"""Benchmark decontamination (operator 2): SimHash of item-sized windows, a multi-index, exact verification.

Shingles are runs of five words (ASCII white space apart, A-Z in lower case). A window of g shingles has a 64-bit
SimHash: bit b is the majority of bit b over its shingles, each as often as it occurs. Window sizes form a
geometric grid; an item takes the largest size that fits in it, and the largest that fits in a third of it, each at
its start, middle and end, so a verbatim copy has a window at distance 0 at each of them. The large windows overlap,
so every edit is in all of them; the thirds are disjoint, so edits that leave enough of the item leave one of them
nearly whole. All windows of every document are fingerprinted; counts of all 64 bits
slide along the text in packed lanes of machine words.

The index cuts fingerprints into four blocks of 16 bits. Two fingerprints within `radius` 11 differ by at most 2
in some block, so looking every block up among the values within distance 2 finds all of them. Each
candidate is then verified: among the windows of the item's own size around its place, the best weighted Jaccard
similarity of shingle multisets must be `similarity` or more. A window that passes the text's start or end is clipped:
it holds the shingles that exist there, so a copy that a text cuts short counts by what it has of the item.

Items are taken `item_block` at a time, each block with one pass over the documents, whose rows are written before the
next block is read, so what the driver holds and what is sent to the executors stays bounded.

Defined cases: null or empty texts and items match nothing; an item of fewer than five words is one shingle of all
its words and matches those words in order; a document shorter than an item has clipped windows only, and
none if it is shorter than the item's smallest fingerprinted window; repeated
rows match alike; a null id is carried along; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._base import batch_words, materialize, named, releasing, _rolled, small_batches, table, utf8

K = 5
BLOCKS, BLOCK_BITS, PER_BLOCK = 4, 16, 2
RADIUS = BLOCKS * (PER_BLOCK + 1) - 1
RATIO = 1.35
LARGEST = 32_000
#: Windows that are fingerprinted together; their arrays then fit a core's cache.
SEGMENT = 32_768


def grid(most: int) -> list[int]:
    out, g = [], 1
    while g <= most:
        out.append(g)
        g = min(max(g + 1, int(g * RATIO)), LARGEST) if g < LARGEST else most + 1
    return out


def _lanes(bits: int) -> np.ndarray:
    """For each part of a hash that fills a machine word with its bits, one in each lane: the word for each byte value."""
    per = 64 // bits
    out = np.zeros((8 // per, 256), dtype=np.uint64)
    for v in range(256):
        for j in range(8):
            out[j // per, v] |= np.uint64((v >> j & 1) << (bits * (j % per)))
    return out


_LANES = {8: _lanes(8), 16: _lanes(16)}


class Counts:
    """Running counts of the 64 bits over a sequence of shingle hashes."""

    def __init__(self, h: np.ndarray):
        self.h, self.sums = h, {}

    def _sum(self, bits: int) -> np.ndarray:
        if bits not in self.sums:
            parts = _LANES[bits]
            out = np.zeros((bits, len(self.h) + 1), dtype=np.uint64)
            for j in range(bits):
                byte = (self.h >> np.uint64(8 * (j // len(parts)))).astype(np.uint8)
                np.cumsum(parts[j % len(parts)][byte], out=out[j, 1:])
            self.sums[bits] = out
        return self.sums[bits]

    def fingerprints(self, g: int) -> np.ndarray:
        """SimHash of each window of g hashes; a lane's difference of sums is exact, whatever wraps around."""
        n = len(self.h) - g + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        bits = 8 if g <= 127 else 16
        c = self._sum(bits)
        half = (1 << (bits - 1)) - 1 - g // 2
        add = np.uint64(sum(half << (bits * i) for i in range(64 // bits)))
        top = np.uint64(sum(1 << (bits * i + bits - 1) for i in range(64 // bits)))
        out, lane = np.zeros(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        for j in range(bits):  # the lanes' top bits of word j go to the j-th place from each lane's end
            np.subtract(c[j, g:], c[j, :-g], out=lane)
            lane += add
            lane &= top
            lane >>= np.uint64(bits - 1 - j)
            out |= lane
        return out


_NEAR = np.array([v for v in range(1 << BLOCK_BITS) if v.bit_count() <= PER_BLOCK], dtype=np.uint32)


class MultiIndex:
    """Fingerprints by the values within PER_BLOCK of each of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.tables = []
        for b in range(BLOCKS):
            own = (prints >> np.uint64(BLOCK_BITS * b) & np.uint64(0xFFFF)).astype(np.uint32)
            value = (own[:, None] ^ _NEAR[None, :]).reshape(-1)
            who = np.repeat(np.arange(len(prints), dtype=np.int32), len(_NEAR))
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1))
            # for each value: whether it has any; where its fingerprints start, how many they are; they themselves in this order
            self.tables.append((np.diff(first) > 0, first[:-1].astype(np.int32), np.diff(first).astype(np.int32), who[order], prints[who[order]]))

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, fingerprint) pairs within RADIUS; some more than once."""
        at, who = [], []
        values = np.ascontiguousarray(windows).astype("<u8", copy=False).view("<u2").reshape(-1, BLOCKS)
        for b, (some, first, count, list_, prints) in enumerate(self.tables):
            v = values[:, b]
            hit = np.flatnonzero(some.take(v))  # most windows have no fingerprint near
            v = v[hit]
            n = count.take(v)
            w = np.repeat(hit, n)
            ends = np.cumsum(n)
            p = np.arange(len(w)) + np.repeat(first.take(v) - (ends - n), n)
            near = np.flatnonzero(np.bitwise_count(windows.take(w) ^ prints.take(p)) <= RADIUS)
            at.append(w[near])
            who.append(list_[p[near]])
        return np.concatenate(at), np.concatenate(who)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def best_window(h: list[int], base: int, m: int, n: int, item: Counter, places: list[int]) -> tuple[float, int]:
    """(similarity, -place) of the window of n shingles, clipped to the text's m, that is most like the item, the first of equal ones.

    h has the text's shingles from base on; places are sorted. The counts slide from place to place.
    """
    total, best = sum(item.values()), (-1.0, 0)
    have, shared, size = Counter(), 0, 0
    for i, x in enumerate(places):
        if i and x == places[i - 1] + 1:
            if x > 0:
                s = h[x - 1 - base]
                shared -= have[s] <= item.get(s, 0)
                have[s] -= 1
                size -= 1
            if x + n <= m:
                s = h[x + n - 1 - base]
                shared += have[s] < item.get(s, 0)
                have[s] += 1
                size += 1
        else:
            have = Counter(h[max(0, x) - base : min(m, x + n) - base])
            shared, size = sum(min(c, item[s]) for s, c in have.items() if s in item), sum(have.values())
        best = max(best, (shared / max(1, total + size - shared), -x))
    return best


class Items:
    """Benchmark items, their index for each shingle length and window size, and their multisets."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids: list[object] = []
        self.sets: list[Counter] = []
        self.k: list[int] = []
        at: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for item, text in items:
            words, counts, _, _ = batch_words([utf8(text)])
            if not len(words):
                continue
            k = min(K, len(words))
            h = _rolled(words, k)
            n, i = len(h), len(self.ids)
            self.ids.append(item)
            self.sets.append(Counter(h.tolist()))
            self.k.append(k)
            own = Counts(h)
            for g in {max(grid(n)), max(grid(max(1, n // 3)))}:
                prints = own.fingerprints(g)
                for off in sorted({0, (n - g) // 2, n - g}):
                    at.setdefault((k, g), []).append((int(prints[off]), i, off))
        self.index = {kg: (MultiIndex(np.array([p for p, _, _ in x], dtype=np.uint64)), np.array([i for _, i, _ in x]), np.array([o for _, _, o in x])) for kg, x in at.items()}
        self.sizes = np.array([sum(s.values()) for s in self.sets], dtype=np.int64)
        self.reach = max((g + k for k, g in at), default=0)

    def search(self, texts: list[bytes], similarity: float) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, word after the last) of each item's best window in each text."""
        words, counts, _, _ = batch_words(texts)
        stops = np.cumsum(counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        found: dict[tuple[int, int], set[int]] = {}
        for s in range(0, len(words), SEGMENT):
            part = words[s : s + SEGMENT + self.reach]
            text = owner[s : s + SEGMENT]
            left = stops[text] - np.arange(s, s + len(text))  # words from here to the text's end
            rolled: dict[int, Counts] = {}
            for (k, g), (index, item, off) in self.index.items():
                if k not in rolled:
                    rolled[k] = Counts(_rolled(part, k))
                prints = rolled[k].fingerprints(g)[:SEGMENT]
                inside = np.flatnonzero(left[: len(prints)] >= g + k - 1)
                w, p = index.search(prints[inside])
                w = inside[w]
                for t, i, a in set(zip(text[w].tolist(), item[p].tolist(), (s + w - off[p]).tolist(), strict=True)):
                    found.setdefault((t, i), set()).add(a)
        out = []
        for (t, i), starts in found.items():
            k, n = self.k[i], int(self.sizes[i])
            low, m = int(stops[t] - counts[t]), int(counts[t]) - k + 1
            least = min(n, max(1, math.ceil(similarity * n - 1e-9)))  # fewer shingles can't reach the similarity
            slack = max(1, n // 4)
            places = sorted({x for a in starts for x in range(max(least - n, a - low - slack), min(m - least, a - low + slack) + 1)})
            if not places:
                continue
            base, end = max(0, places[0]), min(m, places[-1] + n)
            h = _rolled(words[low + base : low + end + k - 1], k).tolist()
            best, where = best_window(h, base, m, n, self.sets[i], places)
            if best >= similarity:
                out.append((t, i, best, max(0, -where), min(m, n - where) + k - 1))
        return sorted(out)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, item_block: int = 2_000) -> DataFrame:
    """key, item, similarity, word_start, word_end: the best window of each item in each document that has one."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    rows = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).filter(F.col("text").isNotNull())
    item_type = to_arrow_type(rows.schema["item"].dataType)
    key_kind, item_kind = src.schema["key"].dataType.simpleString(), rows.schema["item"].dataType.simpleString()
    schema = f"`{key}` {key_kind}, `{item}` {item_kind}, similarity double, word_start long, word_end long"

    def one_pass(block: list[tuple]) -> tuple:
        sent = spark.sparkContext.broadcast(block)  # at most item_block items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items([(i, t) for i, (_, t) in enumerate(sent.value)])
            ids = pa.array([i for i, _ in sent.value], type=item_type)
            for b in batches:
                got = items.search([utf8(t) for t in b.column(1).to_pylist()], similarity)
                cols = [b.column(0).take(pa.array([t for t, *_ in got], type=pa.int64())), ids.take(pa.array([items.ids[i] for _, i, *_ in got], type=pa.int64()))]
                cols += [pa.array([x[j] for x in got], type=k) for j, k in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, item, "similarity", "word_start", "word_end"])

        return src.mapInArrow(releasing(run), schema), sent

    def whole(frame: DataFrame, sent) -> DataFrame:
        """The rows of one block of many, written, so that its broadcast can go."""
        out = materialize(frame)
        sent.destroy()
        return out

    found, block = [], []
    for r in rows.toLocalIterator():  # the stated set of items, a block at a time
        if len(block) == item_block:
            found, block = [*found, whole(*one_pass(block))], []
        block.append((r["item"], r["text"]))
    if block:
        found.append(whole(*one_pass(block)) if found else one_pass(block)[0])
    out = spark.createDataFrame([], schema)
    for frame in found:
        out = out.unionByName(frame)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents in which no item has a window; rows without an id stay."""
    hit = matches(docs, benchmark, key, text, **more).select(F.col(f"`{key}`").alias("hit")).distinct()
    rows = docs.select(named(docs.columns).alias("row"), F.col(f"`{key}`").alias("key"))
    return rows.join(hit, F.col("key") == F.col("hit"), "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
