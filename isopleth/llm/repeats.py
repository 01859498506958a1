"""Removal of repeated byte strings (operator 8), by external induced sorting of suffixes.

Strings of 100 bytes that may be equal must meet in one shard: every string is tied to an anchor, the least hash of the
36-byte runs in it, and shards are dealt by anchor. Strings in a row that share one place of an anchor are a stretch.
Equal stretches are folded on the way (the earliest goes on, later ones are repeats), and an anchor of one stretch
has nothing to compare. A shard joins what is left, its stretches' bytes, into one text, sorts all its suffixes
by external induced sorting (see `induced`), and reads groups of equal strings from the common prefixes: the earliest
stays, the others are repeats. A shard may be far larger than a task's memory.

An anchor with more than HOT different stretches is dealt by more of its context: its strings are cut into pieces by where
the anchor stands in them, and all strings of a piece share 88 bytes, which decide the shard; equal pieces that a task
holds are folded before they are dealt.

Equality of stretches is that of 128 bits of hashes; that of strings is of bytes, to `depth`.

Defined cases: a null or short text has no repeats; documents go by id, a null id first, and rows with the same id by a
hash of their text, then by the text, then as they come, so of repeated rows one keeps its text; ids of any type that
sorts; texts of any length are read whole; an empty table gives no rows; other columns are carried along unchanged,
whatever their names, but a column `spans` is replaced.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from ._base import materialize, mix64, named, releasing, small_batches, table, utf8, with_made

#: Bytes of the strings that must not repeat, of the anchor within each, and places that an anchor can take.
LENGTH, GRAM = 100, 36
PLACES = LENGTH - GRAM + 1
#: Bytes that are hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: Anchors that a task holds before it hands them on.
HOLD = 1 << 18
#: Stretches of one anchor up to which they are dealt by the anchor alone, and places of the anchor in a piece beyond.
HOT, SPREAD = 20_000, 13
#: Bytes of text, and of the sort's queues, that a shard holds in memory.
MEMORY = 64 << 20
#: Stands between stretches; no byte of UTF-8.
BETWEEN = b"\xff"

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ np.uint64(salt)) * _C1 + b * _C2
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


class Grams:
    """Hashes of the runs of 4, 8, 16, 32 bytes that start at each place of a piece, each made of two halves."""

    def __init__(self, raw: np.ndarray, salt: int = 0):
        w = raw.astype(np.uint64)
        self.h4 = w[:-3] | w[1:-2] << np.uint64(8) | w[2:-1] << np.uint64(16) | w[3:] << np.uint64(24)
        h8 = self.h4[:-4] | self.h4[4:] << np.uint64(32)
        h16 = _join(h8[:-8], h8[8:], salt)
        self.h32 = _join(h16[:-16], h16[16:], salt)

    def anchors(self) -> np.ndarray:
        """36 bytes from each place."""
        return mix64(_join(self.h32[: len(self.h4) - 32], self.h4[32 : 32 + len(self.h32)], 1)) if len(self.h4) > 32 else self.h32[:0]

    def strings(self, at: np.ndarray) -> np.ndarray:
        """100 bytes from each of the places given."""
        h64 = _join(self.h32[at], self.h32[at + 32], 2)
        return mix64(_join(_join(h64, self.h32[at + 64], 3), self.h4[at + 96], 4))


def _leftmost_least(h: np.ndarray) -> np.ndarray:
    """For each place the place of the least value among the PLACES values from there, the first of equal ones."""
    n = len(h) - PLACES + 1
    value, place, width = h, np.arange(len(h), dtype=np.int64), 1
    while width * 2 <= PLACES:
        left, right = value[:-width], value[width:]
        later = right < left
        place = np.where(later, place[width:], place[:-width])
        value = np.where(later, right, left)
        width *= 2
    rest = PLACES - width  # the last values, overlapping
    return np.where(value[rest : rest + n] < value[:n], place[rest : rest + n], place[:n])


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For all strings of LENGTH bytes in the texts, by the anchor that they share: the text's index, the first string's
    start, how many more follow, the anchor's place in the first, the anchor's hash, and the hash of all their bytes."""
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        raw = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in held], dtype=np.int64)
        ends = np.cumsum(sizes)
        g = Grams(raw)
        h = g.anchors()
        place = _leftmost_least(h)
        valid = np.zeros(len(raw), dtype=bool)
        for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
            valid[e - s : e - LENGTH + 1] = True
        at = np.flatnonzero(valid[: len(place)])
        mine = place[at]
        new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)])
        first = at[new]
        last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        anchor = mine[new]
        which = np.searchsorted(ends, first, side="right")
        own = np.array([i for i, _, _ in held])[which]
        base = (ends - sizes)[which] - np.array([b for _, b, _ in held], dtype=np.int64)[which]
        more, inner = last - first, anchor - first
        content = _join(_join(g.strings(first), g.strings(last), 5), (more << 8 | inner).astype(np.uint64), 6)
        found.append((own, first - base, more, inner, h[anchor], content))
        held, size = [], 0

    for i in long:
        t = texts[i]
        for b in range(0, len(t) - LENGTH + 1, PIECE):
            piece = t[b : b + PIECE + LENGTH - 1]
            held.append((i, b, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch or overlap."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    head = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(head)
    # the largest end so far within the document: groups are shifted apart so that one pass does for all
    shift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    new = head.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


#: Of kinds 0 and 2: more has in its low 8 bits the number of strings after the first, and then the anchor's place in the first.
_ROW = "a long, b long, doc long, start long, more int"
_OUT = "kind int, " + _ROW


def _frame(kind: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray, more: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(doc), kind, dtype=np.int32), "a": a.view(np.int64), "b": b.view(np.int64), "doc": doc, "start": start, "more": more.astype(np.int32)})


def _spans(doc: np.ndarray, start: np.ndarray, more: np.ndarray) -> pd.DataFrame:
    """Rows of kind 1: bytes to remove, from start; more counts them. Here more counts the strings after the first."""
    doc, start, end = _merged(doc, start, start + more + LENGTH)
    zero = np.zeros(len(doc), dtype=np.uint64)
    return _frame(1, zero, zero, doc, start, end - start)


def _combine(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
    """Of rows (a, b, doc, start, more) with the same a and b the earliest goes on, as kind 0; later ones are repeats."""
    a, b, doc, start, more = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        key = a * _C1 ^ mix64(b)
    o = np.argsort(key, kind="stable")
    k = key[o]
    same = k[1:] == k[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    some = o[many]
    some = some[np.lexsort((start[some], doc[some], b[some], a[some]))]
    new = np.concatenate([[True], (a[some][1:] != a[some][:-1]) | (b[some][1:] != b[some][:-1])])[: len(some)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(some) else some
    late = (doc[some] != doc[some][lead]) | (start[some] != start[some][lead])
    repeats = some[late]
    go = np.concatenate([o[~many], some[new]])
    yield _frame(0, a[go], b[go], doc[go], start[go], more[go])
    if len(repeats):
        yield _spans(doc[repeats], start[repeats], more[repeats] & 255)


def _resolve(rows: DataFrame, want_partial: bool) -> DataFrame:
    """Streams rows sorted by (a, b, doc, start): the earliest of each (a, b) stays, later ones become spans (kind 1).

    With want_partial, earliest rows whose a has several b go on, as kind 2. The state is the last row and the
    first of the current a, so a group of any size streams through.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # a, b, doc and start of the current class' earliest
        first: tuple | None = None  # the first row of the current a, while it may still have to go on
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            passed = batch[kinds == 1]
            if len(passed):
                yield passed
            own = batch[kinds == 0]
            if not len(own):
                continue
            a, b, doc, start, more = (own[c].to_numpy() for c in ("a", "b", "doc", "start", "more"))
            new_a = np.concatenate([[last is None or last[0] != a[0]], a[1:] != a[:-1]])
            new_b = new_a | np.concatenate([[last is None or last[1] != b[0]], b[1:] != b[:-1]])
            heads = np.flatnonzero(new_b)
            lead = np.cumsum(new_b) - 1
            ld = np.where(lead >= 0, doc[heads[np.maximum(lead, 0)]] if len(heads) else 0, last[2] if last else 0)
            ls = np.where(lead >= 0, start[heads[np.maximum(lead, 0)]] if len(heads) else 0, last[3] if last else 0)
            late = ~new_b & ((doc != ld) | (start != ls))
            if late.any():
                yield _spans(doc[late], start[late], more[late] & 255)
            if want_partial:
                again = np.flatnonzero(new_b & ~new_a)  # a further class of the same anchor
                if len(again):
                    top = np.flatnonzero(new_a)
                    of = np.searchsorted(top, again, side="right") - 1
                    inside = np.unique(top[of[of >= 0]])
                    go = np.concatenate([inside, again])
                    if (of < 0).any() and first is not None:
                        yield pd.DataFrame([first], columns=["kind", "a", "b", "doc", "start", "more"])
                        first = None
                    yield _frame(2, a[go], b[go], doc[go], start[go], more[go])
                if new_a.any():
                    t = int(np.flatnonzero(new_a)[-1])
                    first = None if (new_b & ~new_a)[t:].any() else (2, a[t], b[t], doc[t], start[t], more[t])
            if len(heads):
                h = heads[-1]
                last = (a[h], b[h], doc[h], start[h])

    dealt = rows.repartition(F.when(F.col("kind") == 0, F.col("a")).otherwise(F.xxhash64("doc", "start"))).sortWithinPartitions("a", "b", "doc", "start")
    return dealt.mapInPandas(releasing(run), _OUT)


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            own, start, more, inner, gram, content = anchors_of([utf8(t) for t in batch["text"]])
            held.append((gram, content, batch["doc"].to_numpy(dtype=np.int64)[own], start, more | inner << 8))
            n += len(own)
            if n >= HOLD:
                yield from _combine(held)
                held, n = [], 0
        if n:
            yield from _combine(held)

    return docs.mapInPandas(releasing(run), _OUT)


def _runs(partial: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of the strings at each partial row's anchor: a, doc, start, more, hot, bytes."""
    wanted = partial.groupBy("doc").agg(F.collect_list(F.struct("a", "start", "more", "hot")).alias("w"))  # bounded by the text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["a"].map(len).to_numpy()
            start, more = np.concatenate(b["start"].tolist()), np.concatenate(b["more"].tolist())
            end = (start + (more & 255) + LENGTH).tolist()
            texts, at, out = [utf8(t) for t in b["text"]], 0, []
            begin = start.tolist()
            for data, n in zip(texts, size.tolist(), strict=True):
                out += [data[begin[i] : end[i]] for i in range(at, at + n)]
                at += n
            yield pd.DataFrame({"a": np.concatenate(b["a"].tolist()), "doc": np.repeat(b["doc"].to_numpy(), size), "start": start, "more": more, "hot": np.concatenate(b["hot"].tolist()), "bytes": out})

    rows = docs.join(wanted, "doc").select("doc", "text", *(F.col(f"w.{c}").alias(c) for c in ("a", "start", "more", "hot")))
    return rows.mapInPandas(releasing(run), "a long, doc long, start long, more int, hot boolean, bytes binary")


_DEALT = ["kind", "a", "doc", "start", "more", "bytes"]


def _pieces(a: int, doc: int, start: int, packed: int, data: bytes) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """Parts of a stretch whose strings have the anchor at SPREAD neighbouring places: key, document, start, more, bytes. The key is of the bytes that all such strings share."""
    more, inner = packed & 255, packed >> 8
    for low in range((inner - more) // SPREAD * SPREAD, inner + 1, SPREAD):
        high = min(low + SPREAD, PLACES) - 1
        first, last = inner - min(high, inner), inner - max(low, inner - more)
        shared = data[inner - low : inner + LENGTH - high]
        key = hashlib.blake2b(shared, digest_size=8, salt=(a & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), person=bytes([low])).digest()
        yield key, doc, start + first, last - first, data[first : last + LENGTH]


def _dealt(runs: DataFrame) -> DataFrame:
    """Rows of kind 0 for the sort; of hot anchors their pieces, and spans (kind 1) of those that a task has folded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
        late: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pd.DataFrame]:
            rows = [(0, int.from_bytes(key, "little", signed=True), *own, data) for (key, data), own in held.items()]
            rows += [(1, 0, doc, start, more + LENGTH, None) for doc, start, more in late]
            held.clear()
            late.clear()
            if rows:
                yield pd.DataFrame(rows, columns=_DEALT)

        for b in batches:
            hot = b["hot"].to_numpy(dtype=bool)
            plain = b[~hot]
            if len(plain):
                yield plain.assign(kind=0, more=plain["more"] & 255)[_DEALT]
            for row in b[hot][["a", "doc", "start", "more", "bytes"]].itertuples(index=False, name=None):
                for key, doc, start, more, data in _pieces(*row):
                    own, other = (doc, start, more), held.get((key, data))
                    if other is not None:
                        own, after = min(own, other), max(own, other)
                        late.append(after)
                    held[key, data] = own
            if len(held) + len(late) >= HOLD // 8:
                yield from flush()
        yield from flush()

    return runs.mapInPandas(releasing(run), "kind int, a long, doc long, start long, more int, bytes binary")


class Shard:
    """Stretches joined to one text; it goes to an unnamed file when it is larger than `memory`."""

    def __init__(self, memory: int):
        self.memory, self.size = memory, 0
        self.file = tempfile.SpooledTemporaryFile(max_size=memory, dir=induced.scratch_folder())
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: np.ndarray, start: np.ndarray, more: np.ndarray, data: list[bytes]) -> None:
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) + 1
        self.parts.append((doc, start, more & 255, self.size + np.cumsum(sizes) - sizes))
        self.file.write(BETWEEN.join(data) + BETWEEN)
        self.size += int(sizes.sum())

    def text(self) -> np.ndarray:
        self.file.write(b"\0" * 16)
        if self.size + 16 <= self.memory:
            self.file.seek(0)
            return np.frombuffer(self.file.read(), dtype=np.uint8)
        self.file.rollover()
        return np.memmap(self.file, dtype=np.uint8, mode="r", shape=(self.size + 16,))

    def spans(self) -> Iterator[pd.DataFrame]:
        """Spans of all strings that are equal to an earlier one."""
        if not self.parts:
            return
        docs, starts, more, begin = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        late = induced.scratch(self.size, np.bool_, self.memory)
        first: tuple[int, int, int] | None = None  # place, document and start of the earliest string of a group that goes on
        for pos, common in induced.descending(self.text(), self.size, LENGTH, self.memory):
            linked = common >= LENGTH
            some = np.flatnonzero(linked | np.append(linked[1:], True))
            run = np.searchsorted(begin, pos[some], side="right") - 1
            inside = pos[some] - begin[run]
            whole = inside <= more[run]  # others reach over a stretch's end
            some, run, inside = some[whole], run[whole], inside[whole]
            label = np.cumsum(~linked)
            group, place, doc, start = label[some], pos[some], docs[run], starts[run] + inside
            if first is not None and linked[0]:
                group, place, doc, start = (np.append(v, x) for v, x in zip((group, place, doc, start), (0, *first), strict=True))
            order = np.lexsort((start, doc, group))
            head = np.ones(len(order), dtype=bool)
            head[1:] = group[order[1:]] != group[order[:-1]]
            late[place[order[~head]]] = True
            own = order[head][-1:]
            first = (place[own[0]], doc[own[0]], start[own[0]]) if len(own) and group[own[0]] == label[-1] else None
        for a in range(0, self.size, PIECE):
            at = np.flatnonzero(late[a : a + PIECE]) + a
            if len(at):
                run = np.searchsorted(begin, at, side="right") - 1
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])]))
                n = np.diff(np.append(new, len(at)))
                yield _spans(docs[run[new]], starts[run[new]] + at[new] - begin[run[new]], n - 1)


def _sorted(rows: DataFrame, memory: int) -> DataFrame:
    """Spans of the later ones of equal strings: one shard a task, its suffixes sorted. Rows of kind 1 pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(memory)
        for b in batches:
            passed = b[b["kind"] == 1]
            if len(passed):
                yield passed.assign(b=0)[["kind", "a", "b", "doc", "start", "more"]]
            b = b[b["kind"] == 0]
            if len(b):
                shard.add(b["doc"].to_numpy(), b["start"].to_numpy(), b["more"].to_numpy(dtype=np.int64), list(b["bytes"]))
        yield from shard.spans()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small shards aren't joined to larger ones
    dealt = rows.repartition(n, F.when(F.col("kind") == 0, F.col("a")).otherwise(F.xxhash64("doc", "start")))
    return dealt.mapInPandas(releasing(run), _OUT)


def repeats(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """doc, spans (start and end of runs to remove, in order) for docs (doc long, without null or repetition; text)."""
    found = materialize(_resolve(_anchor_rows(docs), True))
    partial = found.filter("kind = 2").select("a", "doc", "start", "more")
    hot = partial.groupBy("a").count().filter(F.col("count") > HOT).select("a", F.lit(True).alias("hot"))
    partial = partial.join(hot, "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rest = materialize(_sorted(_dealt(_runs(partial, docs)), memory))
    spans = found.filter("kind = 1").unionByName(rest)
    return spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("more")).alias("end")))).alias("spans"))


def cut(data: bytes, spans: list) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the maximal runs removed."""
    runs: list[list[int]] = []
    for s in spans:
        if runs and s["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s["end"])
        else:
            runs.append([s["start"], s["end"]])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), [(a, b) for a, b in runs]


def _ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row (the other columns of docs), text, and doc, the documents' order as a number without null or repetition."""
    kind = docs.schema[key].dataType.simpleString()
    plain = kind in ("bigint", "int", "smallint", "tinyint") and not docs.groupBy(F.col(f"`{key}`").alias("k")).count().filter("k is null or count > 1").limit(1).count()
    rows = docs.select(named([c for c in docs.columns if c != text]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    if plain:
        return rows.select("row", "text", F.col("key").cast("long").alias("doc"))
    return materialize(rows.orderBy(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text").select("row", "text", F.monotonically_increasing_id().alias("doc")))


def _found(docs: DataFrame, key: str, text: str, memory: int) -> DataFrame:
    """row, text, spans for each row of docs."""
    small_batches(docs.sparkSession)
    rows = _ordered(docs, key, text)
    return rows.join(repeats(rows.select("doc", "text"), memory), "doc", "left").select("row", "text", "spans")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """docs with spans: the byte runs to remove from the text, or null."""
    kept = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != "spans"]
    return _found(docs, key, text, memory).select(*kept, "spans")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", memory: int = MEMORY) -> DataFrame:
    """docs with the repeats gone from their texts (bytes that are left of a cut character go too); same columns."""

    @F.pandas_udf("string")
    def rest(t: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if s is None or not len(s) else cut(utf8(x), list(s))[0].decode("utf-8", "ignore") for x, s in zip(t, spans, strict=True)], dtype=object)

    made = _found(docs, key, text, memory).withColumn("text", F.when(F.col("spans").isNotNull(), rest("text", "spans")).otherwise(F.col("text")))
    cols = {text: F.col("text")}
    if n_chars in docs.columns:
        cols[n_chars] = F.when(F.col("spans").isNotNull(), F.length("text")).otherwise(F.col(f"row.`{n_chars}`")).cast(docs.schema[n_chars].dataType)
    return made.select(*((cols[c] if c in cols else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(texts: list, spans: list) -> list:
        out = []
        for t, s in zip(texts, spans, strict=True):
            data = utf8(t)
            kept, runs = cut(data, s or [])
            out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        return list(zip(*out, strict=True)) if out else [[], [], [], []]

    return with_made(remove_repeats(docs), ["doc_id"], [F.col("text"), F.col("spans")], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda: digest)


QUERIES = {"op8_repeats": op8_repeats}
#: Every string of 100 bytes by its md5; bytes are written as two hexadecimal digits each.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, g),
parts AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS e FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, n) - s)), '' ORDER BY s) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id),
size AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN size USING (doc_id)"""

ORACLES = {"op8_repeats": ORACLE}
