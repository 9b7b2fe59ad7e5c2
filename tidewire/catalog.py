"""All registered queries of the news engine and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tidewire.queries import feeds, intake, models, more, rounds, scalars

_GROUPS = [feeds.catalog, rounds.catalog, scalars.catalog, models.catalog, more.catalog, intake.catalog]
QUERIES = {k: f for g in _GROUPS for k, f in g.queries.items()}
ORACLE_SQL = {k: q for g in _GROUPS for k, q in g.sql.items()}
