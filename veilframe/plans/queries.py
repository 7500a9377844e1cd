"""The registered queries and the SQL of those that DuckDB can run."""

from __future__ import annotations

from . import actions, cases, evaluation, layout, models, pages, stats, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (texts, pages, layout, evaluation, stats, actions, models, cases):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
