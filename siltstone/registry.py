"""The named queries over the given tables and their SQL."""

from __future__ import annotations

from siltstone.plans import MODULES

FLAGSHIP = "rank_findings"


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
