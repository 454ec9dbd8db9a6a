"""All queries of the core, by name, with their SQL counterparts."""

from __future__ import annotations

from .oracles import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
