"""Registered queries over the driver's tables."""

from . import extended  # noqa: F401  adds its queries to the catalogue
from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
