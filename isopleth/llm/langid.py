"""Language identification (operator 1): words first, then shorter and shorter character n-grams.

The model holds, for each language, the log frequency of its words and of the character n-grams of those words
(`<` and `>` mark a word's ends). A known word scores by its own log frequencies. An unseen word backs off: its
4-grams score it if any of them is known, else its 3-grams, 2-grams, single letters. Scores add up over a text.

Fitting reads a sample of labelled rows, about `max_fit_rows` of them, chosen by a hash of the id among all rows
that may be learned from, and about `max_fit_bytes` of text (a classifier may be fitted on a bounded sample); within
it every text counts whole, whatever its size, and every word goes into the model. So the sample's bytes bound what is
sent to every executor. Prediction reads every text whole.

Defined cases: a null text or one without a letter is `und` with score 0; rows without a language aren't learned
from; ties go to the language with more text in the sample, then to the smaller name; without any row to learn
from every text is `und`; repeated rows are predicted alike; ids are carried as they are, null ones too; a column in
`keep` that has the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import crc_mod, gram_hashes, marked, releasing, small_batches, table, with_made

_WORD = re.compile(r"[^\W\d_]+")
MAX_GRAM = 4
UND = "und"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """Log frequencies, one column a language: rows for `words`, and for each n rows for sorted n-gram hashes."""

    def __init__(self, counts: dict[str, Counter], alpha: float = 0.5):
        totals = {lang: sum(c.values()) for lang, c in counts.items()}
        self.langs = sorted(counts, key=lambda x: (-totals[x], x))
        self.words = sorted(set().union(*counts.values())) if counts else []
        table = np.array([[counts[lang][w] for lang in self.langs] for w in self.words], dtype=np.float64).reshape(len(self.words), len(self.langs))
        self.word_rows = self._log(table, alpha)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        codes, sizes = marked(self.words)
        for n in range(1, MAX_GRAM + 1):
            hashes, owner = gram_hashes(codes, sizes, n)
            names, index = np.unique(hashes, return_inverse=True)
            rows = np.stack([np.bincount(index, weights=table[owner, j], minlength=len(names)) for j in range(len(self.langs))], axis=1) if self.langs else np.zeros((0, 0))
            self.grams[n] = names, self._log(rows, alpha)

    @staticmethod
    def _log(rows: np.ndarray, alpha: float) -> np.ndarray:
        return np.log((rows + alpha) / (rows.sum(axis=0) + alpha * max(1, len(rows)))).astype(np.float32)


class Scorer:
    """Looks words up and keeps what it found; the store is emptied when it is full."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.langs, self.most = model, model.langs, most
        self._reset()

    def _reset(self) -> None:
        words = self.model.words
        self.ids = dict(zip(words, range(len(words)), strict=True))
        self.rows = np.zeros((max(1024, 2 * len(words)), len(self.langs)), dtype=np.float32)
        self.rows[: len(words)] = self.model.word_rows

    def backoff(self, words: list[str]) -> np.ndarray:
        """For each word the mean of its known n-grams at the largest n that has any; zeros without any."""
        out = np.zeros((len(words), len(self.langs)))
        todo = np.arange(len(words))
        for n in range(MAX_GRAM, 0, -1):
            if not len(todo):
                break
            hashes, owner = gram_hashes(*marked([words[i] for i in todo]), n)
            names, rows = self.model.grams[n]
            at = np.minimum(np.searchsorted(names, hashes), max(0, len(names) - 1))
            known = names[at] == hashes if len(names) else np.zeros(len(hashes), dtype=bool)
            at, owner = at[known], owner[known]
            hits = np.bincount(owner, minlength=len(todo))
            some = hits > 0
            for j in range(len(self.langs)):
                out[todo[some], j] = np.bincount(owner, weights=rows[at, j], minlength=len(todo))[some] / hits[some]
            todo = todo[~some]
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Takes in the words of some texts that it hasn't seen."""
        if len(self.ids) > self.most:
            self._reset()
        new = list({w for words in texts for w in words if w not in self.ids})
        first = len(self.ids)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(new)] = self.backoff(new)
        self.ids.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        each = [words_of(t) if self.langs and has_letter(t) else [] for t in texts]
        self.learn(each)
        get, out = self.ids.__getitem__, []
        for words in each:
            if not words:
                out.append((UND, 0.0))
                continue
            sums = self.rows[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
            best = int(np.argmax(sums))
            out.append((self.langs[best], float(1.0 / np.exp(np.clip(sums - sums[best], -700, 0)).sum())))
        return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_fit_rows: int = 20_000, max_fit_bytes: int = 64 << 20) -> Model:
    """A model from the rows of docs that have a language and a text."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, max_fit_rows / max(1, n), max_fit_bytes / max(1, size))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < int((1 << 30) * share))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, Counter] = {}
        size = 0
        for b in batches:
            for x, t in zip(b["lang"], b["text"], strict=True):
                c = own.setdefault(x, Counter())
                size -= len(c)
                c.update(words_of(t))
                size += len(c)
            if size > 500_000:
                yield _rows(own)
                own, size = {}, 0
        yield _rows(own)

    def _rows(own: dict[str, Counter]) -> pd.DataFrame:
        return pd.DataFrame([(x, w, k) for x, c in own.items() for w, k in c.items()], columns=["lang", "word", "n"])

    counts = rows.filter(F.col("text").isNotNull()).select("lang", "text").mapInPandas(releasing(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, Counter] = {}
    got = counts.toArrow()  # at most the words of the sample
    for x, w, k in zip(got["lang"].to_pylist(), got["word"].to_pylist(), got["n"].to_pylist(), strict=True):
        found.setdefault(x, Counter())[w] = k
    return Model(found)


def predict(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with the predicted language and its share of the likelihood."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(sent.value)

        def work(texts: list) -> list:
            got = scorer.predict(texts)
            return [[x for x, _ in got], [v for _, v in got]]

        return work

    return with_made(docs, keep, [F.col(f"`{text}`")], f"`{out[0]}` string, `{out[1]}` double", start)


def held_out(key: str = "doc_id", n: int = 5, fold: int = 0) -> Column:
    return crc_mod(key, n) == fold


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
