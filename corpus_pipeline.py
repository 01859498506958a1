"""A corpus pipeline: quality rules, near-duplicates, repeated strings, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before kept. All but
the last return the columns of docs. Near-duplicates are documents whose sets of five-word shingles have a
similarity of 0.8 or more; repeated strings are those of 100 bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isopleth.llm import decontaminate, minhash, quality, repeats, sentencepiece_codec
from isopleth.llm._base import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that fail or lose too much go."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return minhash.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that occur earlier go."""
    return repeats.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item's window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with their digest and that of the text decoded from them."""
    return sentencepiece_codec.encode(docs, keep=("doc_id", "lang", "source"), emit=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The last stages have no form in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
