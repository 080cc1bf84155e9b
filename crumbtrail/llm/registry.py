"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from crumbtrail.llm import queries_documents, queries_reviews, queries_tables

_MODULES = (queries_reviews, queries_tables, queries_documents)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
