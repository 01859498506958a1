"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, langid, minhash, quality, repeats, sentencepiece_codec, sharding, toxicity, url_filter

_MODULES = (langid, decontaminate, url_filter, sharding, sentencepiece_codec, minhash, chat, repeats, quality, toxicity)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
