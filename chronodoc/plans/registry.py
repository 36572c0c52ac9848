"""All queries of the library outside the optional llm subpackage, and their SQL."""

from __future__ import annotations

from chronodoc.plans import documents, feeds, stores

MODULES = [documents, feeds, stores]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
