"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from . import queries_books, queries_contracts, queries_early, queries_regimes, queries_search, queries_streams, queries_universe  # noqa: F401  they add to the same tables
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
