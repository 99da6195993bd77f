"""All registered queries of the library itself, and their SQL."""

from __future__ import annotations

from . import event_queries, join_queries, station_queries, text_queries

_PARTS = (text_queries, event_queries, join_queries, station_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
