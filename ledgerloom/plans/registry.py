"""All registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from ledgerloom.plans import codes, core_problems, ingest, models, rankings, statistics, streams, texts, timelines, workflow

_MODULES = (core_problems, ingest, timelines, codes, rankings, statistics, texts, streams, models, workflow)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
