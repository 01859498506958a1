"""URL filters (operator 3): all glob rules run as one bit-parallel wildcard automaton.

A glob is `host/path`, matched against the canonical form of a URL, `host NUL path`: `?` is any one byte, `*` any
run of bytes within its part, other characters stand for themselves. Each glob takes one bit for its start and
one for each symbol; the bits of all globs are packed in 64-bit words. For a byte c, B[c] has the bits whose
symbol accepts c and L[c] those that a following star holds in place, so a step for every glob at once is
D = ((D << 1) & B[c]) | (D & L[c]), carried from word to word (Baeza-Yates and Gonnet 1992; Navarro and
Raffinot 2002). Many URLs take the step together, one column of bytes at a time.

Rules with a verdict: `Rule(host, path, verdict)` fits the host and its subdomains and paths that start with its
path; it compiles to two globs, and the longest rule that fits wins. If none fits, the plain globs decide: a URL
that a block glob matches is blocked, unless an allow glob matches it too; others are allowed.

Defined cases: a null URL, or one without `://`, has empty host and path, which only globs of stars match; bytes
outside ASCII are matched as UTF-8; URLs of any length are read whole; repeated rows are judged alike; an empty
table gives no rows; ids are carried as they are, null ones too; columns besides the id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import small_batches, table, with_made

_SEP = 0
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty without `://`."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].translate(_UPPER), rest[cut:end]


def _symbols(glob: str, literal: bool) -> list[int | str]:
    """Bytes, '?' for any byte, '*' for a run; literal: no wildcards."""
    out: list[int | str] = []
    for ch in glob:
        if not literal and ch in "*?":
            out.append(ch)
        else:
            out.extend(ch.encode("utf-8", "replace"))
    return out


class Automaton:
    """Shift-And over packed words for all patterns. A pattern is a list of symbols for the host and one for the path."""

    def __init__(self, patterns: Iterable[tuple[list[int | str], list[int | str]]]):
        patterns = list(patterns)
        loops: list[tuple[int, bool]] = []  # bit, whether in the path
        starts, finals, bit = [], [], 0
        steps: list[tuple[int, int | str, bool]] = []
        for host, path in patterns:
            starts.append(bit)
            for part, in_path in ((host, False), ([_SEP], False), (path, True)):
                for s in part:
                    if s == "*":
                        loops.append((bit, in_path))
                    else:
                        bit += 1
                        steps.append((bit, s, in_path))
            finals.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.B = np.zeros((256, self.words), dtype=np.uint64)
        self.L = np.zeros((256, self.words), dtype=np.uint64)
        for b, s, _ in steps:
            word, mask = b // 64, np.uint64(1 << (b % 64))
            if s == "?":
                self.B[1:, word] |= mask
            else:
                self.B[s, word] |= mask
        for b, _ in loops:
            self.L[1:, b // 64] |= np.uint64(1 << (b % 64))
        self.start = np.zeros(self.words, dtype=np.uint64)
        for b in starts:
            self.start[b // 64] |= np.uint64(1 << (b % 64))
        self.final_word = np.array([b // 64 for b in finals], dtype=np.int64)
        self.final_bit = np.array([b % 64 for b in finals], dtype=np.uint64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each pattern: whether the pattern matches the whole text."""
        out = np.zeros((len(texts), len(self.final_word)), dtype=bool)
        block = max(1, 2_000_000 // (self.words * 8))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # like lengths together
        for at in range(0, len(order), block):
            ids = order[at : at + block]
            sizes = np.array([len(texts[i]) for i in ids])
            D = np.broadcast_to(self.start, (len(ids), self.words)).copy()
            for t0 in range(0, int(sizes[0]), 256):  # a slab of columns, so a long text doesn't widen the rest
                live = int(np.searchsorted(-sizes, -t0, side="left"))
                slab = np.zeros((live, 256), dtype=np.uint8)
                for r in range(live):
                    piece = texts[ids[r]][t0 : t0 + 256]
                    slab[r, : len(piece)] = np.frombuffer(piece, dtype=np.uint8)
                for t in range(min(256, int(sizes[0]) - t0)):
                    n = int(np.searchsorted(-sizes, -(t0 + t), side="left"))
                    d, c = D[:n], slab[:n, t]
                    moved = d << np.uint64(1)
                    moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                    D[:n] = (moved & self.B[c]) | (d & self.L[c])
            out[ids] = (D[:, self.final_word] >> self.final_bit) & np.uint64(1)
        return out


class UrlFilter:
    """Rules and plain globs, compiled into one automaton."""

    def __init__(self, rules: Iterable[Rule] = (), block: Iterable[str] = (), allow: Iterable[str] = ()):
        self.rules = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
        self.block, self.allow = list(block), list(allow)
        patterns = []
        for r in self.rules:
            path = [*_symbols(r.path, True), "*"]
            patterns += [(_symbols(r.host.translate(_UPPER), True), path), (["*", *_symbols("." + r.host.translate(_UPPER), True)], path)]
        for g in self.block + self.allow:
            host, slash, path = g.partition("/")
            patterns.append((_symbols(host.translate(_UPPER), False), _symbols(slash + path, False)))
        self.automaton = Automaton(patterns)

    def judge(self, urls: list[str | None]) -> dict[str, list]:
        """host, path, rule, verdict and globs (the plain ones that match), a list each."""
        parts = [canonical(u) for u in urls]
        hit = self.automaton.matches([h.encode("utf-8", "replace").replace(b"\0", b"\1") + b"\0" + p.encode("utf-8", "replace").replace(b"\0", b"\1") for h, p in parts])
        nr, nb = len(self.rules), len(self.block)
        plain = hit[:, 2 * nr :]
        blocked = plain[:, :nb].any(axis=1) & ~plain[:, nb:].any(axis=1)
        fits = hit[:, : 2 * nr].reshape(len(urls), nr, 2).any(axis=2)
        first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if nr else np.full(len(urls), -1)
        names = self.block + self.allow
        globs: list[list[str]] = [[] for _ in urls]
        for i, j in zip(*(v.tolist() for v in np.nonzero(plain)), strict=True):
            globs[i].append(names[j])
        return {
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "rule": [self.rules[i].name if i >= 0 else None for i in first],
            "verdict": [self.rules[i].verdict if i >= 0 else ("block" if b else "allow") for i, b in zip(first, blocked, strict=True)],
            "globs": globs,
        }


def filter_urls(pages: DataFrame, rules: UrlFilter, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, and the plain globs that match."""
    small_batches(pages.sparkSession, 4096)
    return with_made(pages, [key], [F.col(f"`{url}`").cast("string")], "host string, path string, rule string, verdict string, globs array<string>", lambda: lambda urls: list(rules.judge(urls).values()))


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: What the method itself blocks where no rule fits.
BLOCK = ("spam-*/*", "*.spam-*/*", "*/*.exe", "*/*.zip", "*casino*/*", "*/wp-login*")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), UrlFilter(RULES, BLOCK)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN " + "{}"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    )
    order = sorted(RULES, key=lambda r: -len(r.name))
    globs = " OR ".join(f"(host GLOB '{g.partition('/')[0]}' AND path GLOB '/{g.partition('/')[2]}')" for g in BLOCK)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS hp FROM u),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(h) + 1) AS path FROM p)
SELECT page_id, host, path, CASE {fits.format(*(f"'{r.name}'" for r in order))} ELSE NULL END AS rule,
  CASE {fits.format(*(f"'{r.verdict}'" for r in order))} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM q"""


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES = {"op3_url_filter": _oracle()}
