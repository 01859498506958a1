"""Null ids, long texts, clashing columns and empty tables, for every operator; and the pipeline against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece as spm

from isopleth.llm import chat, decontaminate, langid, minhash, quality, repeats, sentencepiece_codec, sharding, toxicity, url_filter
from isopleth.llm._base import shingle_sets

BIG = 9007199254740993
WORDS = [f"w{i}" for i in range(400)]
SPACE = "[^\x20\x09-\x0d]+"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Ids beside a null one, a very long text, repeated rows, and columns named like those used inside."""
    rng = random.Random(4)
    long = prose(rng, 400_000)
    rows = [(BIG, "the cat"), (None, "der hund"), (3, None), (4, ""), (5, long), (6, "twice told"), (6, "twice told"), (None, None)]
    names = "row int, key int, text2 int, kept int, made int, in0 int, score string, h int, n int, g int, doc int, spans int, cell int, hit int"
    return spark.createDataFrame([(i, t, "en", *([1] * 6), "x", *([1] * 7)) for i, t in rows], "doc_id long, text string, lang string, " + names), long


IDS = [None, None, 3, 4, 5, 6, 6, BIG]


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=lambda v: (v is not None, v or 0))


def test_rows_keep_their_ids(odd, spark):
    df, long = odd
    model = langid.Model({"en": Counter(the=3, cat=2, twice=1), "de": Counter(der=3, hund=2)})
    got = langid.predict(df, model, keep=("doc_id", "score", "kept")).collect()
    assert ids(got) == IDS and {r["doc_id"]: r["lang_pred"] for r in got}[BIG] == "en" and all(isinstance(r["score"], float) for r in got)
    tox = toxicity.Model(np.zeros(1 << 10, dtype=np.float32), 0.0)
    assert ids(toxicity.score(df, tox, keep=("doc_id", "score", "made")).collect()) == IDS
    got = sentencepiece_codec.encode(df, keep=("doc_id", "row"), emit=("n_tokens", "ids_sha256")).collect()
    assert ids(got) == IDS
    assert {r["doc_id"]: r["n_tokens"] for r in got}[5] == 2 + len(spm.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes()).encode(long))
    assert ids(minhash.near_duplicates(df).collect()) == IDS
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and ids(kept.collect()) == IDS
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    assert set(got) == set(IDS) and not got[BIG]["spans"] and not got[5]["spans"]
    got = sharding.assign(df, 1000).collect()
    assert ids(got) == IDS and {r["doc_id"]: r["oversize"] for r in got}[5]
    assert ids(quality.judge(df).collect()) == IDS
    bench = spark.createDataFrame([(BIG, "the cat"), (None, " ".join(long.split()[1000:1060]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(BIG, BIG), (5, None)}
    assert ids(decontaminate.clean(df, bench).collect()) == [None, None, 3, 4, 6, 6]
    pages = spark.createDataFrame([(BIG, "http://a.org/x", 1), (None, None, 1), (7, "http://b.com/" + "a" * 300_000 + ".exe", 1), (7, "http://b.com/", 1)], "page_id long, url string, host int")
    got = {(r["page_id"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.UrlFilter(url_filter.RULES, url_filter.BLOCK)).collect()}
    assert got == {(BIG, "allow"), (None, "allow"), (7, "block"), (7, "allow")}
    assert url_filter.filter_urls(pages.limit(0), url_filter.UrlFilter()).count() == 0
    talk = spark.createDataFrame([(BIG, 0, "user", long), (BIG, 1, "assistant", "yes"), (None, 0, "user", "hi"), (BIG, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.packs(talk)).collect()}
    assert got[BIG]["n_turns"] == 3 and got[BIG]["loss_chars"] == 6 and got[None]["n_turns"] == 1


def test_language_against_plain_python(spark):
    rng = random.Random(8)
    vocabulary = {"en": ["the", "water", "thing", "house"], "de": ["der", "wasser", "haus", "das"], "fr": ["le", "eau", "chose", "maison"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(8)), x) for i, x in enumerate(["en", "de", "fr"] * 12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = defaultdict(Counter)
    for _, t, x in rows:
        counts[x].update(t.split())
    order = sorted(counts, key=lambda x: (-sum(counts[x].values()), x))
    tables = [Counter(), *({x: Counter() for x in order} for _ in range(4))]
    for x in order:
        for w, k in counts[x].items():
            for n in range(1, 5):
                m = f"<{w}>" if n > 1 else w
                for i in range(len(m) - n + 1):
                    tables[n][x][m[i : i + n]] += k
    words = set().union(*counts.values())

    def log(table, names, x, key):
        return math.log((table[x][key] + 0.5) / (sum(table[x].values()) + 0.5 * len(names)))

    def plain(text):
        total = dict.fromkeys(order, 0.0)
        for w in text.split():
            if w in words:
                for x in order:
                    total[x] += log(counts, words, x, w)
                continue
            for n in range(4, 0, -1):
                names = set().union(*tables[n].values())
                m = f"<{w}>" if n > 1 else w
                hits = [m[i : i + n] for i in range(len(m) - n + 1) if m[i : i + n] in names]
                if hits:
                    for x in order:
                        total[x] += sum(log(tables[n], names, x, h) for h in hits) / len(hits)
                    break
        best = max(order, key=lambda x: (total[x], -order.index(x)))
        return best, 1 / sum(math.exp(v - total[best]) for v in total.values())

    texts = ["the water", "wasserhaus", "maisonette le", "xq", "thinghouse das", "eaux choses"]
    for got, t in zip(langid.Scorer(model).predict(texts), texts):
        want = plain(t)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-4)


def test_language_learns_every_word_of_its_sample(spark):
    rows = [(i, "common " + "".join(chr(97 + int(c)) for c in str(i)) + "rare", "en" if i % 2 else "de") for i in range(600)]
    assert len(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).words) == 601


def test_toxicity_score_against_plain_python():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=1 << 12).astype(np.float32), 0.3)

    def plain(text):
        words = [w for w in (x.strip(toxicity._EDGES) for x in text.lower().split()) if w]
        z = 0.0
        for w in words:
            rows, _ = toxicity.subwords([w], 1 << 12)
            assert len(rows) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in range(3, 7))  # the word and its 3- to 6-grams
            z += model.margins[rows].mean() / len(words)
        return 1 / (1 + math.exp(-(model.bias + z)))

    texts = ["you idiot!", "a", "Well, well. WELL", "", "x" * 300]
    assert toxicity.Scorer(model)(texts) == pytest.approx([plain(t) for t in texts], rel=1e-5)


def test_toxicity_training_lowers_the_loss():
    rng = random.Random(2)
    texts = [prose(rng, 12) + (" vile" if i % 3 == 0 else "") for i in range(300)]
    labels = [int(i % 3 == 0) for i in range(300)]

    def loss(steps):
        p = toxicity.Scorer(toxicity.train(texts, labels, steps=steps))(texts)
        return -np.mean([math.log(max(1e-9, q if y else 1 - q)) for q, y in zip(p, labels)])

    assert loss(60) < 0.2 * loss(1)


# --- the pipeline, stage by stage


def plain_quality(text):
    w = re.findall(SPACE, text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    if len(w) < 20 or 100 * len(mark) > 30 * len(w):
        return None

    ended = lambda x: bool(re.search(r"[.!?…:;][)\]}\"'”’»]*\s*$", x[-12:]))
    marked = any(ended(x) for x in text.split("\n") if re.search(SPACE, x))

    def fails(line):
        n = len(re.findall(SPACE, line))
        size = len(re.sub(r"[\x20\x09-\x0d]", "", line))
        letters, upper = sum(c.isalpha() for c in line), sum(c.isupper() for c in line)
        bars, symbols = sum(c in "|»›→•·" for c in line), sum(c in "#*$%&|<>" for c in line)
        return (
            not letters
            or (marked and n >= 12 and not ended(line))
            or (n >= 4 and bars and bars >= 0.25 * n)
            or symbols > 0.2 * size
            or (bool(re.search("[A-Z]{3}", line)) and n >= 4 and letters >= 10 and upper > 0.7 * letters)
            or ("!!" in line and n >= 4 and len(line.split("!!")) - 1 >= 0.3 * n)
            or (len(line) <= 200 and any(p in line.lower() for p in quality.BOILERPLATE))
        )

    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    bad = [x for x in lines if fails(x)]
    size = lambda xs: sum(len("".join(re.findall(SPACE, x))) for x in xs)
    if size(bad) > 0.5 * size(lines):
        return None
    return "\n".join(x for x in lines if x not in bad) if bad else text


def shingles(text, k=5):
    w = re.findall(SPACE, text.lower())
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def plain_dedup(rows):
    sets, comp = {i: set(shingles(t)) for i, t in rows.items()}, {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    return {i: t for i, t in rows.items() if comp[i] == i}


def plain_repeats(rows):
    seen, out = set(), {}
    for i in sorted(rows):
        b = rows[i].encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        out[i] = bytes(c for c, m in zip(b, mark) if not m).decode("utf-8", "ignore")
    return out


def plain_clean(rows, items):
    def hit(text, item):
        d, n = shingles(text), len(shingles(item))
        want = Counter(shingles(item))
        for s in range(-n + 1, len(d)):
            have = Counter(d[max(0, s) : s + n])
            shared = sum((have & want).values())
            if shared / max(1, sum(have.values()) + n - shared) >= 0.8:
                return True
        return False

    return {i: t for i, t in rows.items() if not any(hit(t, x) for x in items)}


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    sentence = lambda n: prose(rng, n).capitalize() + "."
    text = lambda k: "\n".join(sentence(rng.randint(6, 18)) for _ in range(k))
    item, passage = prose(rng, 40), prose(rng, 55) + "."
    rows = {i: text(rng.randint(4, 12)) for i in range(24)}
    rows |= {30: rows[3], 31: rows[4].replace("w1 ", "w2 ", 1), 32: rows[5] + "\n" + item + ".", 33: "too short.", 34: None, 35: text(5) + "\nhome | shop | cart | help", 36: " | ".join(prose(rng, 90).split())}
    rows |= {37: text(4) + "\n" + passage + "\n" + text(3), 38: text(5) + "\n" + passage, 39: text(3) + "\n" + prose(rng, 30), 40: rows[6] + "\n" + text(1), 41: (sentence(9) + " ") * 6, 42: text(6) + "\nAll rights reserved."}
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, key int, row int"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows.items()], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {i: x for i, t in rows.items() if (x := plain_quality(t)) is not None}
    want = plain_clean(plain_repeats(plain_dedup(want)), [item])
    assert 32 not in want and 30 not in want and 36 not in want and passage not in want[38]
    lib = spm.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        tokens = lib.encode(t, add_bos=True, add_eos=True)
        assert got[i]["ids"] == tokens and got[i]["n_tokens"] == len(tokens), i
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(tokens, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(tokens).encode()).hexdigest()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.tokens(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_batches_with_fewer_words_than_a_shingle(spark):
    text = prose(random.Random(8), 60)
    items = decontaminate.Items([(1, text)])
    for n in range(9):
        few = " ".join(WORDS[:n])
        assert items.search([few.encode()], 0.8) == []
        long = f"{text} {prose(random.Random(n), decontaminate.SEGMENT - 60 + n)}"  # the last segment has n words
        assert items.search([long.encode()], 0.8) == [(0, 0, 1.0, 0, 60)]
        assert shingle_sets([few.encode()], 5)[1].tolist() == [0 if not n else max(1, n - 4)]
    docs = spark.createDataFrame([(1, "only three words")], "doc_id long, text string").coalesce(1)
    assert decontaminate.clean(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).collect() == docs.collect()
    assert [r["n_shingles"] for r in minhash.near_duplicates(docs).collect()] == [1]


def test_chat_row_groups_are_small(spark):
    import pyarrow.parquet as pq

    # one task's packs: 24 of some MB each, which one row group held
    rng = random.Random(7)
    turns = [(i, 0, "user", f"{i:03} " + rng.choice("abcdef") * 270_000) for i in range(24)]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        packed = chat.packs(talk)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in packed.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) >= 20 and max(groups) <= 8
    got = {r["conv_id"]: r["turns_sha256"] for r in chat.read_back(packed).collect()}
    assert got == {c: hashlib.sha256(f"{role}\n{text}\n".encode()).hexdigest() for c, _, role, text in turns}
