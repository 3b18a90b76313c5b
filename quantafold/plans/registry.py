"""All queries of the core and their SQL."""

from __future__ import annotations

from . import analytics, core_problems, evaluation, facts, layout, structure, tables, texts, windows

_MODULES = (core_problems,)
_REGISTERS = (analytics.queries, evaluation.queries, facts.queries, layout.queries, structure.queries, tables.queries, texts.queries, windows.queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()} | {name: f for r in _REGISTERS for name, f in r.queries.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()} | {name: s for r in _REGISTERS for name, s in r.sql.items()}
