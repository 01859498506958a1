"""All registered queries and their SQL."""

from __future__ import annotations

from .operators import audits, centres, charts, explain, learning, local, models, pattern

_FAMILIES = (audits, charts, pattern, local, centres, models, learning, explain)


def queries() -> dict:
    out: dict = {}
    for m in _FAMILIES:
        out |= {k: s.query for k, s in m.STATEMENTS.items()} | getattr(m, "QUERIES", {})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _FAMILIES:
        out |= {k: s.oracle() for k, s in m.STATEMENTS.items()} | getattr(m, "ORACLES", {})
    return out
