"""All queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from ledgerloom.llm import queries, text_queries

_MODULES = (queries, text_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
