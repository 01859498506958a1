"""External induced sorting of suffixes with their common prefixes (Nong, Zhang and Chan 2009; Bingmann, Fischer and Osipov 2013).

A suffix is of type S if it is smaller than the next one, else of type L; an S suffix after an L suffix is a seed. From
sorted seeds one ascending scan induces the order of all L suffixes, and one descending scan that of all S suffixes:
whenever a suffix is taken from the queue of its first symbol, the suffix before it joins the queue of its own first
symbol, with one more than the least common-prefix value since the last that joined there. Seeds are sorted the
same way: a first pair of scans sorts the strings between seeds, these get names, and the string of names, less than
half as long, is sorted by recursion, until it has `fits` names at most and is ranked in memory by doubling.

All steps take blocks of suffix tuples (place, common prefix), as arrays. Queues hold `memory` bytes together; beyond,
their tuples go to an unnamed file in Spark's own scratch folder, as do arrays that are larger than `memory`. So a
string far larger than memory can be sorted; only counts of each symbol are always held. Nothing is left behind, and a
lost task starts anew.

Orders and common prefixes are exact up to `depth` symbols; suffixes that agree so far come in any order.

Defined cases: an empty string gives no blocks; a string of one repeated symbol is sorted like any other, one
round of its queue for each symbol.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples that are taken from a queue at once, symbols that one queue holds in wide alphabets, alphabets that count as wide.
BLOCK, RANGE, WIDE = 1 << 16, 1 << 20, 512


def scratch_folder() -> str | None:
    """The folder that Spark gives its executors for spilling; None: the system's."""
    folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
    return folder if os.path.isdir(folder) else None


def _scratch_file():
    return tempfile.TemporaryFile(dir=scratch_folder())


def scratch(n: int, dtype, memory: int) -> np.ndarray:
    """Zeros; in an unnamed file if they are more than memory bytes."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype=dtype)
    with _scratch_file() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype=dtype, mode="r+", shape=(n,))


class Spool:
    """What the queues of one sort hold together; beyond `memory` bytes all of it goes to the file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.spilled, self.file = memory, 0, 0, None
        self.queues: set[Queue] = set()

    def grew(self, queue: Queue, size: int) -> None:
        self.held += size
        self.queues.add(queue)
        if self.held > self.memory:
            if self.file is None:
                self.file = _scratch_file()
            for q in self.queues:
                q.spill()
            self.queues.clear()
            self.held = 0

    def write(self, data: np.ndarray) -> int:
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(data.tobytes())
        self.spilled += data.nbytes
        return at

    def read(self, at: int, n: int, dtype) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(dtype).itemsize), dtype=dtype)


class Queue:
    """Tuples (place, common prefix) that leave from either end in the order in which they came."""

    __slots__ = ("parts", "size", "spool")

    def __init__(self, spool: Spool):
        self.spool, self.parts, self.size = spool, deque(), 0

    def push(self, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        self.parts.append((pos, lcp))
        self.size += len(pos)
        self.spool.grew(self, 9 * len(pos))

    def spill(self) -> None:
        kept: deque = deque()
        run: list = []

        def close() -> None:
            if run:
                pos = np.concatenate([p for p, _ in run])
                lcp = None if run[0][1] is None else np.concatenate([x for _, x in run])
                kept.append((self.spool.write(pos), -1 if lcp is None else self.spool.write(lcp), len(pos)))
                run.clear()

        for part in self.parts:
            if len(part) == 3:
                close()
                kept.append(part)
            else:
                run.append(part)
        close()
        self.parts = kept

    def pop(self, limit: int = BLOCK, right: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Up to limit tuples from the left or the right end, in the order in which they came."""
        got, n = [], 0
        while self.parts and n < limit:
            part = self.parts.pop() if right else self.parts.popleft()
            if len(part) == 3:
                at, at_lcp, size = part
                k = min(size, limit - n)
                skip = size - k if right else 0
                pos = self.spool.read(at + 8 * skip, k, np.int64)
                lcp = None if at_lcp < 0 else self.spool.read(at_lcp + skip, k, np.uint8)
                if k < size:
                    (self.parts.append if right else self.parts.appendleft)((at, at_lcp, size - k) if right else (at + 8 * k, at_lcp + k if at_lcp >= 0 else -1, size - k))
            else:
                pos, lcp = part
                self.spool.held -= 9 * len(pos)
            got.append((pos, lcp))
            n += len(pos)
        self.size -= n
        if right:
            got.reverse()
        if len(got) == 1:
            return got[0]
        return np.concatenate([p for p, _ in got]), None if got[0][1] is None else np.concatenate([x for _, x in got])


def _words(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte of x as a number; x must have 8 bytes to spare at its end."""
    return np.ndarray((x.nbytes - 7,), dtype="<u8", buffer=x, strides=(1,))


def _range_min(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of v[low..high] for each pair, from minima over runs of 1, 2, 4 ... values."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = [v]
    for k in range(int(level.max()) if len(level) else 0):
        step = 1 << k
        last = table[-1]
        table.append(np.minimum(last[:-step], last[step:]))
    out = np.empty(len(low), dtype=v.dtype)
    for k, t in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << k) + 1])
    return out


class Symbols:
    """A string of bytes or names, with what the scans ask of it."""

    def __init__(self, x: np.ndarray, n: int, memory: int):
        #: The symbols, and 16 bytes of zeros at the end at least.
        self.raw, self.x, self.n, self.memory = x, x[:n], n, memory
        self.item = x.dtype.itemsize
        self.words = _words(x)
        self.sigma = int(self.x.max()) + 1 if n else 0

    def seeds(self) -> np.ndarray:
        """Places of the seeds, ascending."""
        x, n, after = self.x, self.n, False
        out = scratch(n // 2 + 1, np.int64, self.memory)  # no two seeds are neighbours
        at = len(out)
        for stop in range(n, 0, -BLOCK * 16):
            start = max(0, stop - BLOCK * 16)
            part = x[start:stop]
            follow = x[start + 1 : stop + 1]
            if len(follow) < len(part):  # the end of the string is less than all symbols
                follow = np.append(follow, part[-1])
            step = (follow > part).astype(np.int8) - (follow < part).astype(np.int8)
            if stop == n:
                step[-1] = -1
            known = np.flatnonzero(step)
            nxt = np.searchsorted(known, np.arange(len(part)))
            rising = np.full(len(part), after)
            some = nxt < len(known)
            rising[some] = step[known[nxt[some]]] > 0
            after = bool(rising[0])
            before = x[start - 1 : stop - 1] if start else np.concatenate([part[:1], part[:-1]])
            found = np.flatnonzero(rising & (before > part))
            out[at - len(found) : at] = found + start
            at -= len(found)
        return out[at:]

    def by_symbol(self, places: np.ndarray) -> np.ndarray:
        """The places sorted by their symbols, otherwise in their order."""
        out = scratch(len(places), np.int64, self.memory)
        counts = self.counts(places)
        at = np.cumsum(counts) - counts
        for a in range(0, len(places), RANGE):
            part = places[a : a + RANGE]
            symbols = self.x[part]
            order = np.argsort(symbols, kind="stable")
            symbols = symbols[order]
            head = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            size = np.diff(np.append(head, len(symbols)))
            out[np.repeat(at[symbols[head]] - head, size) + np.arange(len(symbols))] = part[order]
            at[symbols[head]] += size
        return out

    def counts(self, places: np.ndarray | None = None) -> np.ndarray:
        """How many of the places, or of all, have each symbol."""
        out = np.zeros(self.sigma, dtype=np.int64)
        n = self.n if places is None else len(places)
        for a in range(0, n, RANGE):
            out += np.bincount(self.x[a : a + RANGE] if places is None else self.x[places[a : a + RANGE]], minlength=self.sigma)
        return out

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b, depth at most; for strings of bytes."""
        out = np.full(len(a), depth, dtype=np.int64)
        live = np.arange(len(a))
        top = len(self.words) - 1
        for k in range(0, depth, 8):
            diff = self.words[np.minimum(a[live] + k, top)] ^ self.words[np.minimum(b[live] + k, top)]
            other = diff != 0
            with np.errstate(over="ignore"):
                out[live[other]] = k + np.bitwise_count((diff[other] & -diff[other]) - np.uint64(1)) // 8
            live = live[~other]
        return np.minimum(out, np.minimum(depth, self.n - np.maximum(a, b))).astype(np.uint8)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the runs of size symbols from a and from b are equal."""
        out = np.ones(len(a), dtype=bool)
        live, k = np.arange(len(a)), 0
        a, b, size = a * self.item, b * self.item, size * self.item
        while len(live) > 16:
            left = size[live] - k
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.maximum(left, 0)).astype(np.uint64) % np.uint64(64)) - np.uint64(1))
            equal = (self.words[a[live] + k] ^ self.words[b[live] + k]) & mask == 0
            out[live[~equal]] = False
            live = live[equal & (left > 8)]
            k += 8
        data = self.raw.view(np.uint8)
        for i in live.tolist():
            out[i] = np.array_equal(data[a[i] + k : a[i] + size[i]], data[b[i] + k : b[i] + size[i]])
        return out


class Scans:
    """The two inducing scans over one string. Without depth no common prefixes are carried."""

    def __init__(self, s: Symbols, depth: int | None):
        self.s, self.depth = s, depth
        self.spool = Spool(s.memory)
        wide = depth is None and s.sigma > WIDE
        if wide:  # ranges of symbols that hold about RANGE suffixes each
            counts = s.counts()
            self.range_of = ((np.cumsum(counts) - counts) // RANGE).astype(np.int64)
            self.first = np.flatnonzero(np.concatenate([[True], self.range_of[1:] != self.range_of[:-1]]))
            self.range_of = np.searchsorted(self.first, np.arange(s.sigma), side="right") - 1
        else:
            self.range_of, self.first = None, np.arange(s.sigma)
        self.bounds = np.append(self.first, s.sigma)
        self.since = np.zeros(s.sigma, dtype=np.uint8) if depth else None

    def _begin(self) -> None:
        self.queues: dict[int, Queue] = {}
        self.inner: dict[int, Queue] = {}
        self.current = -1
        if self.depth:
            self.since[:] = 0

    def _push(self, symbols: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        """symbols come sorted; each run of one symbol joins its queue."""
        if not len(symbols):
            return
        if self.range_of is None:
            self._split(self.queues, symbols, pos, lcp)
            return
        ranges = self.range_of[symbols]
        here = ranges == self.current
        self._split(self.inner, symbols[here], pos[here], None)
        self._split(self.queues, ranges[~here], pos[~here], None)

    def _split(self, queues: dict[int, Queue], keys: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        if not len(keys):
            return
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = [0, *cuts.tolist(), len(keys)]
        for i, key in enumerate(keys[at[:-1]].tolist()):
            q = queues.get(key)
            if q is None:
                q = queues[key] = Queue(self.spool)
            a, b = at[i], at[i + 1]
            q.push(pos[a:b], None if lcp is None else lcp[a:b])

    def _spread(self, pos: np.ndarray, lcp: np.ndarray | None, c: int, up: bool, strict: bool) -> None:
        """The suffixes before these join their queues, if they are of the scan's type."""
        prev = self.s.x[pos - 1]  # at place 0 this wraps around, and is masked
        if up:
            ok = prev > c if strict else prev >= c
        else:
            ok = prev < c if strict else prev <= c
        at = np.flatnonzero(ok & (pos > 0))
        order = np.argsort(prev[at], kind="stable")
        source = at[order]
        symbols = prev[source]
        if lcp is None:
            self._push(symbols, pos[source] - 1, None)
            return
        since = self.since
        if not len(source):
            np.minimum(since, lcp.min(), out=since)
            return
        head = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        low = np.concatenate([[0], source[:-1] + 1])
        low[head] = 0
        least = _range_min(lcp, low, source)
        mine = symbols[head]
        least[head] = np.minimum(least[head], since[mine])
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        np.minimum(since, after[0], out=since)
        since[mine] = after[source[np.append(np.flatnonzero(head)[1:], len(head)) - 1] + 1]
        self._push(symbols, pos[source] - 1, np.minimum(least, self.depth - 1) + np.uint8(1))

    def _turns(self, up: bool) -> Iterator[int]:
        """Each symbol in the scan's order; its queue is self.turn."""
        for r in range(len(self.first)) if up else range(len(self.first) - 1, -1, -1):
            self.current = r
            waiting = self.queues.pop(r, None) or Queue(self.spool)
            if self.range_of is None:
                self.turn = self.queues[r] = waiting
                yield r
                self.queues.pop(r)
                continue
            self.inner = {}
            while waiting.size:
                pos, _ = waiting.pop()
                symbols = self.s.x[pos]
                order = np.argsort(symbols, kind="stable")
                self._split(self.inner, symbols[order], pos[order], None)
            symbols = range(self.bounds[r], self.bounds[r + 1])
            for c in symbols if up else reversed(symbols):
                self.turn = self.inner.setdefault(c, Queue(self.spool))
                yield c
                del self.inner[c]

    def up(self, seeds: np.ndarray, seed_lcp: np.ndarray | None, keep: Callable[[np.ndarray, int], np.ndarray] | None) -> dict[int, Queue]:
        """The L suffixes by symbol, ascending; seeds are sorted by their first symbols at least. keep may leave some out."""
        x, out = self.s.x, {}
        self._begin()
        ends = np.concatenate([[0], np.cumsum(self.s.counts(seeds))]).tolist()
        if self.s.n:  # the end of the string comes first
            last = np.array([self.s.n - 1])
            key = int(x[-1]) if self.range_of is None else int(self.range_of[x[-1]])
            self.queues[key] = Queue(self.spool)
            self.queues[key].push(last, np.zeros(1, np.uint8) if self.depth else None)
        for c in self._turns(True):
            done, before = Queue(self.spool), None
            while self.turn.size:
                pos, lcp = self.turn.pop()
                if lcp is not None and before is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                before = pos[-1]
                self._spread(pos, lcp, c, True, False)
                some = pos if keep is None else keep(pos, c)
                if len(some):
                    done.push(some, lcp)
            if done.size:
                out[c] = done
            for a in range(ends[c], ends[c + 1], BLOCK):
                b = min(a + BLOCK, ends[c + 1])
                lcp = None
                if self.depth:
                    lcp = seed_lcp[a:b].copy()
                    if a == ends[c]:
                        lcp[0] = 0 if before is None else self.s.common(np.array([before]), seeds[a : a + 1], self.depth)[0]
                self._spread(np.asarray(seeds[a:b]), lcp, c, True, True)
        return out

    def down(self, ls: dict[int, Queue]) -> Iterator[tuple[np.ndarray, np.ndarray | None, bool]]:
        """All suffixes descending, in blocks: places, common prefixes with the suffix just before in this order, and whether they are of type S."""
        self._begin()
        for c in self._turns(False):
            before = None
            while self.turn.size:
                pos, lcp = self.turn.pop()
                if lcp is not None and before is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                before = pos[-1]
                self._spread(pos, lcp, c, False, False)
                yield pos, lcp, True
            queue, carried = ls.pop(c, None), None
            while queue is not None and queue.size:
                pos, lcp = queue.pop(right=True)
                pos = pos[::-1]
                if lcp is not None:  # a value belongs to a suffix and the smaller one, so all move on by one
                    if carried is None:
                        first = 0 if before is None else self.s.common(np.array([before]), pos[:1], self.depth)[0]
                    else:
                        first = carried
                    carried = lcp[0]
                    lcp = np.concatenate([[np.uint8(first)], lcp[::-1][:-1]])
                self._spread(pos, lcp, c, False, True)
                yield pos, lcp, False


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes of names, to depth symbols; in memory."""
    rank, step = names.astype(np.int64) + 1, 1
    while True:
        follow = np.zeros(len(rank), dtype=np.int64)
        follow[:-step] = rank[step:]
        key = rank * (int(rank.max()) + 1) + follow
        order = np.argsort(key)
        fresh = np.cumsum(np.concatenate([[1], (key[order[1:]] != key[order[:-1]])]))
        rank[order] = fresh
        step *= 2
        if step >= depth or step >= len(rank) or fresh[-1] == len(rank):
            return order


def _sorted_seeds(s: Symbols, depth: int, fits: int) -> np.ndarray:
    """The seeds' places in the order of their suffixes, to depth symbols at least."""
    seeds = s.seeds()
    m = len(seeds)
    if m < 2:
        return seeds
    x = s.x
    scans = Scans(s, None)
    ls = scans.up(s.by_symbol(seeds), None, lambda pos, c: pos[(pos > 0) & (x[pos - 1] < c)])
    order, at = scratch(m, np.int64, s.memory), m
    for pos, _, rising in scans.down(ls):
        if rising:
            pos = pos[(pos > 0) & (x[pos - 1] > x[pos])]
            at -= len(pos)
            order[at : at + len(pos)] = pos[::-1]
    index = scratch(s.n // 2 + 1, np.uint32, s.memory)  # the number of the seed at either of two places
    for a in range(0, m, RANGE):
        index[seeds[a : a + RANGE] >> 1] = np.arange(a, min(m, a + RANGE), dtype=np.uint32)
    names = scratch(m + 4, np.uint32, s.memory)
    name = 0
    for a in range(0, m, RANGE):  # equal strings between seeds stand together and share a name
        own = index[order[a : a + RANGE] >> 1].astype(np.int64)
        last = index[order[a - 1 : a] >> 1].astype(np.int64) if a else own[:1]
        prev = np.concatenate([last, own[:-1]])
        size, size_prev = (seeds[np.minimum(i + 1, m - 1)] - seeds[i] + 1 for i in (own, prev))
        new = (size != size_prev) | (own == m - 1) | (prev == m - 1)
        same = np.flatnonzero(~new)
        new[same] = ~s.same(seeds[own[same]], seeds[prev[same]], size[same])
        if a == 0:
            new[0] = False
        got = name + np.cumsum(new)
        names[own] = got
        name = int(got[-1])
    if name == m - 1:
        return order
    if m <= fits:
        return seeds[_doubled(names[:m], depth // 2 + 1)]
    places = scratch(m, np.int64, s.memory)
    at = m
    for pos, _, _ in _descending(Symbols(names, m, s.memory), depth // 2 + 1, fits, False):
        at -= len(pos)
        places[at : at + len(pos)] = seeds[pos[::-1]]
    return places


def _descending(s: Symbols, depth: int, fits: int, common: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None, bool]]:
    seeds = _sorted_seeds(s, depth, fits)
    lcp = None
    if common:
        lcp = scratch(len(seeds), np.uint8, s.memory)
        for a in range(1, len(seeds), BLOCK):
            lcp[a : a + BLOCK] = s.common(seeds[a - 1 : a - 1 + len(seeds[a : a + BLOCK])], seeds[a : a + BLOCK], depth)
    scans = Scans(s, depth if common else None)
    yield from scans.down(scans.up(seeds, lcp, None))


def descending(text: np.ndarray, n: int, depth: int = 100, memory: int = 256 << 20, fits: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the places of all suffixes of the bytes text[:n], in descending order, each with the length of its common
    prefix with the suffix just before it in this order, depth (under 250) at most. text has 16 zero bytes after n."""
    if len(text) < n + 16 or text.dtype != np.uint8 or not 0 < depth < 250:
        raise ValueError("bytes with 16 to spare, and a depth under 250")
    for pos, lcp, _ in _descending(Symbols(text, n, memory), depth, fits, True):
        yield pos, lcp
