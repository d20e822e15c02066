"""Collects the queries of all plan modules."""

from __future__ import annotations

from lineloom.plans import layout, matching, relational, rollup, rules, service, sources, text
from lineloom.plans.base import Query

MODULES = (text, relational, rollup, rules, layout, matching, service, sources)
FLAGSHIP = matching.FLAGSHIP


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
