"""Every query of the library by name, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from lodestrata.plans import demand, equipment, joins, operations, quality, retrieval, sales  # noqa: F401  they register their queries
from lodestrata.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
