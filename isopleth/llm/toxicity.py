"""Toxicity (operator 10): subword-bag embeddings, averaged, into a linear softmax; all trained jointly in numpy.

A word is the bag of its own entry and its character n-grams (3 to 6, `<` and `>` at its ends), hashed into
`buckets` rows of an embedding; its vector is their mean. A text is the mean of its words' vectors, and a softmax
over two classes reads it (Joulin et al. 2017). A misspelling shares most n-grams with the word it hides.

Training takes a sample of labelled rows by a hash of the id, at most about `max_fit_rows` and about `max_fit_bytes`
of text in all; a classifier may be fitted on a bounded sample. Texts in it are read whole, whatever their size, and
no word or n-gram is left out. Scoring reads every text whole. As the
softmax is linear, a word adds one number to its text's mean, so a worker computes it once for each word.

Defined cases: a null text or one without a word scores as the bias alone; rows without a label aren't learned
from; a document with several label rows is learned from once for each different label; with no labelled row of both classes every
score is the share of the label (0 without rows); repeated rows score alike; ids are carried as they are, null ones
too; a column `score` in `keep` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import crc_mod, gram_hashes, marked, small_batches, table, with_made, word_hash

_EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_…«»“”‘’"


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w] if text else []


def subwords(words: list[str], buckets: int, low: int = 3, high: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words' bags, and how many each word has; grouped by word."""
    codes, sizes = marked(words)
    rows, owners = [word_hash(codes, sizes)], [np.arange(len(words))]
    for n in range(low, high + 1):
        hashes, owner = gram_hashes(codes, sizes, n)
        rows.append(hashes)
        owners.append(owner)
    flat, owner = np.concatenate(rows) % np.uint64(buckets), np.concatenate(owners)
    return flat[np.argsort(owner, kind="stable")].astype(np.int64), np.bincount(owner, minlength=len(words))


class Model:
    def __init__(self, margins: np.ndarray, bias: float):
        #: For each bucket the class-1 minus class-0 margin of its embedding.
        self.margins, self.bias = margins, bias


def _features(texts: Iterable[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """For each text its distinct words and their shares; then all words' bags one after the other, their sizes, and the embedding rows that the bags' numbers stand for."""
    index: dict[str, int] = {}
    docs = []
    for t in texts:
        d = np.array([index.setdefault(w, len(index)) for w in words_of(t)], dtype=np.int32)
        words, n = np.unique(d, return_counts=True)
        docs.append((words, (n / max(1, len(d))).astype(np.float32)))
    words, bags, sizes = list(index), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    del index
    for i in range(0, len(words), 20_000):  # some words at a time, to hold few hashes
        rows, n = subwords(words[i : i + 20_000], buckets)
        bags.append(rows.astype(np.int32))
        sizes.append(n)
    flat, size = np.concatenate(bags), np.concatenate(sizes)
    seen = np.zeros(buckets, dtype=bool)
    seen[flat] = True
    return docs, (np.cumsum(seen, dtype=np.int32) - 1)[flat], size, np.flatnonzero(seen)


def train(texts: Iterable[str], labels: list[int], buckets: int = 1 << 19, dim: int = 8, steps: int = 360, batch: int = 256, rate: float = 0.05, seed: int = 7) -> Model:
    """Adam on the cross-entropy, over embedding and softmax together. Texts are kept as word numbers and words as bags, once each; a step expands the words of its batch."""
    y = np.asarray(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(buckets, dtype=np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    docs, flat, size, used = _features(texts, buckets)
    start = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1.0 / dim, 1.0 / dim, (len(used), dim)).astype(np.float32)
    W = np.zeros((dim, 2), dtype=np.float32)
    W[:, 1] = rng.uniform(-0.1, 0.1, dim)
    W[:, 0] = -W[:, 1]
    b = np.array([np.log(1 - share), np.log(share)], dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, W, b)]
    full = rng.permutation([i for i, (w, _) in enumerate(docs) if len(w)])
    parts = [full[at : at + batch] for at in range(0, len(full), batch)]
    for step in range(1, steps + 1 if parts else 1):
        ids = parts[(step - 1) % len(parts)]
        target, weights = y[ids], np.concatenate([docs[i][1] for i in ids])
        n = np.array([len(docs[i][0]) for i in ids])
        words, back = np.unique(np.concatenate([docs[i][0] for i in ids]), return_inverse=True)
        sz = size[words]
        first_row = np.cumsum(sz) - sz
        rows = flat[np.arange(int(sz.sum())) + np.repeat(start[words] - first_row, sz)]
        share_of = (1 / sz).astype(np.float32)[:, None]
        V = np.add.reduceat(E[rows], first_row, axis=0) * share_of
        H = np.add.reduceat(V[back] * weights[:, None], np.cumsum(n) - n, axis=0)
        Z = H @ W + b
        P = np.exp(Z - Z.max(axis=1, keepdims=True))
        P /= P.sum(axis=1, keepdims=True)
        P[np.arange(len(target)), target] -= 1
        G = (P / len(target)).astype(np.float32)
        gD = np.repeat(G @ W.T, n, axis=0) * weights[:, None]
        gV = np.stack([np.bincount(back, weights=gD[:, j], minlength=len(words)) for j in range(dim)], axis=1).astype(np.float32) * share_of
        order = np.argsort(rows, kind="stable")
        touched, first = np.unique(rows[order], return_index=True)
        gE = np.add.reduceat(gV[np.repeat(np.arange(len(words)), sz)[order]], first, axis=0)
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for (m, v), p, g, at in zip(state, (E, W, b), (gE, H.T @ G, G.sum(axis=0)), (touched, slice(None), slice(None)), strict=True):
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            p[at] -= (rate * fix * m[at] / (np.sqrt(v[at]) + 1e-8)).astype(np.float32)
    margins = np.zeros(buckets, dtype=np.float32)
    margins[used] = E @ (W[:, 1] - W[:, 0])
    return Model(margins, float(b[1] - b[0]))


class Scorer:
    """Keeps each word's number; the store is emptied when it is full."""

    def __init__(self, model: Model, most: int = 800_000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        each = [words_of(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = list({w for words in each for w in words if w not in known})
        if new:
            rows, size = subwords(new, len(self.model.margins))
            sums = np.bincount(np.repeat(np.arange(len(new)), size), weights=self.model.margins[rows], minlength=len(new))
            known.update(zip(new, (sums / size).tolist(), strict=True))
        get = known.__getitem__
        z = np.array([self.model.bias + (sum(map(get, words)) / len(words) if words else 0.0) for words in each])
        return (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_fit_rows: int = 12_000, max_fit_bytes: int = 64 << 20) -> Model:
    """A model from the labelled documents; labels has the key and the label."""
    marks = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("key").isNotNull())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())

    def sample(of: DataFrame, part: float) -> DataFrame:
        return of.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * part)) if part < 1 else of

    # a document with several marks counts once for each label; a key's share of the hash space decides for all its marks
    marks = marks.groupBy("key", "label").agg(F.count("*").alias("times"))
    n = marks.count()
    part = min(1.0, max_fit_rows / max(1, n))
    size = rows.join(F.broadcast(sample(marks, part)), "key").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the marks are about max_fit_rows of three numbers each by now
    got = rows.join(F.broadcast(sample(marks, part * min(1.0, max_fit_bytes / max(1, size)))), "key").select("key", "text", "label").toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    return train((t.as_py() for t in got["text"]), [1 if x else 0 for x in got["label"].to_pylist()])


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with score, the probability of label 1."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(sent.value)
        return lambda texts: [scorer(texts)]

    return with_made(docs, keep, [F.col(f"`{text}`")], "score double", start)


THRESHOLD = 0.3


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod("doc_id", 4) != 2)
    model = fit(docs, labels)
    return score(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
