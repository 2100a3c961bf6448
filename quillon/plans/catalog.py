"""The registered queries of the retrieval engine, and their DuckDB equivalents."""

from __future__ import annotations

from . import corpus_plans, reader_plans, search_plans, tool_plans  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_rrf"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
