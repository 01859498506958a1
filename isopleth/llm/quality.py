"""Quality rules, line first (operator 9), in SQL functions only.

Every line is judged by itself: lines of many words that no mark of punctuation ends (in texts that end some line so), navigation (many `|` cells, or
words parted by bullets or arrows), symbol noise, shouting, boilerplate phrases and lines without a letter fail.
Failing lines are removed; a document that loses more than `max_lost` of the characters in its words is rejected. Some
rules look at the whole document first (too few words, too many repeated 8-word windows): such a document is
rejected whatever its lines say. Windows are compared by 64-bit hashes.

Defined cases: a null or empty text has no words and is rejected; lines are split at \\n only; copies of a row
are judged alike, one row out for each row in; a null id is kept as it is; texts of any length are judged whole; an empty
table gives no rows; other columns pass through in `clean`, whatever their names, unless they begin with its prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = r"[^#*$%&|<>]+"
#: What ends a sentence, also in other scripts, and what may follow it in a line.
_END = r"""[.!?…。！？।؟۔:;][\p{Pe}\p{Pf}\p{Pi}"']*[\x20\x09-\x0D]*$"""
#: Characters at a line's end among which its mark is looked for.
_TAIL = 12
#: What parts the links of a menu or of a trail.
_PARTS = r"[^|»›→•·]+"
#: Phrases of page furniture; a short line that holds one is removed.
BOILERPLATE = ("all rights reserved", "terms of service", "privacy policy", "cookie policy", "enable javascript", "lorem ipsum", "click here to subscribe", "skip to main content")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8  #: a power of two
    max_lost: float = 0.5
    unended_words: int = 12  #: a line of so many words must end in a mark of punctuation
    max_bars: float = 0.25  #: bars, bullets and arrows for each word, in lines of 4 words or more
    max_symbols: float = 0.2  #: share of symbols
    max_upper: float = 0.7  #: share of capitals, in lines with three in a row
    max_bangs: float = 0.3  #: `!!` for each word, in lines of 4 words or more
    boilerplate_chars: int = 200
    phrases: tuple[str, ...] = BOILERPLATE


def _words(text: Column) -> Column:
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _only(text: Column, others: str) -> Column:
    """Code points left when all others are removed."""
    return F.length(F.regexp_replace(text, others, ""))


def _paired(hashes: Column, step: int) -> Column:
    """The hash of each hash with the one step places on; the last step values pair with nothing."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.greatest(F.lit(0), F.size(hashes) - step)), lambda a, b: F.xxhash64(a, b))


def _placed(windows: Column) -> Column:
    """Where hashes repeat, each with its window's place, sorted; else nothing."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:bigint>>"))


def _repeated(placed: Column, k: int) -> Column:
    """Words in windows that occur twice or more, the first time included.

    A place counts if a neighbour has the same hash; places found, in order, each add the words that the one before
    hasn't covered. placed is a column of its own: it is looked into once for each element.
    """
    n = F.size(placed)
    places = F.sort_array(
        F.transform(
            F.filter(placed, lambda v, i: ((i > 0) & (F.get(placed, i - 1)["h"] == v["h"])) | ((i < n - 1) & (F.get(placed, i + 1)["h"] == v["h"]))),
            lambda v: v["i"],
        )
    )
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-k).cast("bigint").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(k).cast("bigint"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def _ended(line: Column) -> Column:
    return F.right(line, F.lit(_TAIL)).rlike(_END)


def _line_fails(line: Column, rules: Rules, marked: Column) -> Column:
    """Whether a line with words is noise; marked: whether the text ends any line with a mark of punctuation. Cheap tests guard the counts, which prose then never comes to."""
    n_words = F.size(_words(line))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    low = F.lower(line)
    furniture = F.lit(False)
    for phrase in rules.phrases:
        furniture = furniture | low.contains(phrase)
    return (
        ~line.rlike(r"\p{L}")
        | (marked & ~_ended(line) & (n_words >= rules.unended_words))
        | (line.rlike(r"[#*$%&|<>»›→•·]") & (((n_words >= 4) & (_only(line, _PARTS) >= F.greatest(F.lit(1), rules.max_bars * n_words))) | (_only(line, _SYMBOLS) > rules.max_symbols * _only(line, _SPACE + "+"))))
        | (line.rlike(r"\p{Lu}{3}") & (n_words >= 4) & (letters >= 10) & (upper > rules.max_upper * letters))
        | (line.contains("!!") & (n_words >= 4) & (F.size(F.split(line, "!!")) - 1 >= rules.max_bangs * n_words))
        | ((F.length(line) <= rules.boilerplate_chars) & furniture)
    )


def judge(docs: DataFrame, text: str = "text", rules: Rules = Rules(), prefix: str = "q_") -> DataFrame:
    """Adds the counts and verdicts, each named with the prefix: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept; and lines and bad, the lines with words and those that fail, and marked, whether any line ends in a mark."""
    p = prefix
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    staged = docs.withColumns({f"{p}words": _words(whole), f"{p}lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    staged = staged.withColumn(f"{p}hashes", F.transform(f"{p}words", lambda w: F.xxhash64(w)))
    for step in (1 << i for i in range(rules.window.bit_length() - 1)):  # windows of 2, 4, 8 ... words
        staged = staged.withColumn(f"{p}hashes", _paired(F.col(f"{p}hashes"), step))
    staged = staged.withColumn(f"{p}marked", F.exists(f"{p}lines", _ended))
    full = F.size(f"{p}words") - (rules.window - 1)
    staged = staged.withColumns({f"{p}windows": F.slice(f"{p}hashes", 1, F.greatest(F.lit(0), full)), f"{p}bad": F.filter(F.col(f"{p}lines"), lambda x: _line_fails(x, rules, F.col(f"{p}marked")))})
    staged = staged.withColumn(f"{p}placed", _placed(F.col(f"{p}windows")))
    staged = staged.withColumns(
        {
            f"{p}n_words": F.size(f"{p}words").cast("bigint"),
            f"{p}word_chars": F.length(F.array_join(f"{p}words", "")).cast("bigint"),
            f"{p}n_symbols": _only(whole, _SYMBOLS).cast("bigint"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("bigint"),
            f"{p}n_repeat_words": _repeated(F.col(f"{p}placed"), rules.window),
            f"{p}lost_chars": F.when(F.size(f"{p}bad") == 0, F.lit(0)).otherwise(_only(F.array_join(f"{p}bad", ""), _SPACE + "+")).cast("bigint"),
        }
    )
    staged = staged.withColumn(f"{p}base_failed", (F.col(f"{p}n_words") < rules.min_words) | (100 * F.col(f"{p}n_repeat_words") > rules.max_repeat_percent * F.col(f"{p}n_words")))
    staged = staged.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}lost_chars") <= rules.max_lost * F.col(f"{p}word_chars")))
    return staged.drop(*(p + x for x in ("words", "hashes", "windows", "placed")))


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with failing lines gone from their texts; same columns as before."""
    p = "__quality_"
    judged = judge(docs, text, rules, p)
    # a generator holds the filter above it; pushed down, it would take the counts apart and repeat them
    verdicts = F.inline(F.array(F.struct(*(F.col(f"{p}{x}") for x in ("kept", "bad", "lines", "marked")))))
    out = judged.select(*(F.col(f"`{c}`") for c in docs.columns), verdicts.alias(f"{p}kept", f"{p}bad", f"{p}lines", f"{p}marked")).filter(F.col(f"{p}kept"))
    changed = F.size(f"{p}bad") > 0
    out = out.withColumn(f"{p}clean", F.when(changed, F.array_join(F.filter(f"{p}lines", lambda x: ~_line_fails(x, rules, F.col(f"{p}marked"))), "\n")))
    made = {text: F.coalesce(F.col(f"{p}clean"), F.col(f"`{text}`"))}
    if n_chars and n_chars in docs.columns:
        made[n_chars] = F.when(changed, F.length(f"{p}clean")).otherwise(F.col(f"`{n_chars}`")).cast(docs.schema[n_chars].dataType)
    return out.select(*(made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from ._base import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, prefix="").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def _oracle(rules: Rules = Rules()) -> str:
    words = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    seen = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
    ending = _END.replace("'", "''")
    phrases = " OR ".join(f"contains(lower(line), '{x}')" for x in rules.phrases)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {words.format('t')} AS ws,
  {seen.format('t')} AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, i - coalesce(p, i - 8))) AS n FROM rep GROUP BY r),
line AS (SELECT r, unnest(ls) AS line FROM w),
counts AS (SELECT r, line, bool_or(regexp_matches(right(line, {_TAIL}), '{ending}')) OVER (PARTITION BY r) AS marked, len({words.format('line')}) AS n, {seen.format('line')} AS seen,
  length(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) AS upper_,
  length(regexp_replace(line, '{_PARTS}', '', 'g')) AS bars, regexp_matches(right(line, {_TAIL}), '{ending}') AS ended, len(string_split(line, '!!')) - 1 AS bangs,
  length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS sym FROM line),
lost AS (SELECT r, sum(seen) AS n FROM counts WHERE letters = 0 OR (marked AND NOT ended AND n >= {rules.unended_words}) OR (bars > 0 AND n >= 4 AND bars >= {rules.max_bars} * n) OR (sym > 0 AND sym > {rules.max_symbols} * seen)
  OR (regexp_matches(line, '\p{{Lu}}{{3}}') AND n >= 4 AND letters >= 10 AND upper_ > {rules.max_upper} * letters) OR (bangs > 0 AND n >= 4 AND bangs >= {rules.max_bangs} * n)
  OR (length(line) <= {rules.boilerplate_chars} AND ({phrases})) GROUP BY r),
fin AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_chars FROM w LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM fin)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= {rules.max_lost} * word_chars AS kept, lost_chars FROM b"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _oracle()}
