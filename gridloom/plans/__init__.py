"""Registered queries and their SQL."""

from gridloom.plans import catalog, more, per_row, scenes

QUERIES = catalog.QUERIES | more.QUERIES | per_row.QUERIES | scenes.QUERIES
SQL = catalog.SQL | more.SQL | per_row.SQL | scenes.SQL

__all__ = ["QUERIES", "SQL"]
