"""All queries of the library proper, and the SQL that states them for the other engine."""

from __future__ import annotations

from .plans import convert_queries, files_queries, relation_queries, text_queries

_MODULES = (files_queries, text_queries, relation_queries, convert_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.Q.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.O.items()}
