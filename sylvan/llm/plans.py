"""Registered queries of the text operators."""

from __future__ import annotations

from sylvan.llm import contamination, doc_pairs, mixing, parse_check, provenance, same_look

_MODULES = [doc_pairs, provenance, parse_check, contamination, mixing, same_look]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
