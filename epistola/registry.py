"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from .plans import store_queries, tool_queries
from .plans.oracles import ORACLE_SQL as _SQL
from .plans.queries import QUERIES as _QUERIES

QUERIES = _QUERIES | tool_queries.QUERIES | store_queries.QUERIES
ORACLE_SQL = _SQL | tool_queries.ORACLE_SQL | store_queries.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES"]
